"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``waymark.llm.queries`` lists the
registered queries and their SQL.
"""
