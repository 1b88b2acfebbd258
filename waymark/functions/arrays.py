"""Folds over arrays whose steps give a row each, without copying the rows at each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold appends; what is copied grows with an array's size times this.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it in functions of elements."""
    return F.transform(F.array(value), body)[0]


def fold_rows(values: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column] | Column], row: str) -> Column:
    """The rows that step(state, element) gives besides the next state, in order; null rows are left out.

    values: a column's name; row: the rows' type. A step gives the two by themselves, or as one struct of state and row,
    which is worked out once. Blocks of elements are folded one
    after the other, and only a block's rows are appended to.
    """
    none = F.array().cast(f"array<{row}>")

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            rows = lambda out: F.when(out.isNull(), acc["rows"]).otherwise(F.concat(acc["rows"], F.array(out)))
            both = step(acc["state"], x)
            if isinstance(both, Column):
                return let(both, lambda b: F.struct(b["state"].alias("state"), rows(b["row"]).alias("rows")))
            return F.struct(both[0].alias("state"), rows(both[1]).alias("rows"))

        return F.aggregate(block, F.struct(state.alias("state"), none.alias("rows")), one)

    def outer(acc: Column, k: Column) -> Column:
        done = inner(acc["state"], F.slice(F.col(values), k * BLOCK + 1, F.lit(BLOCK)))
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["rows"], F.array(d["rows"])).alias("rows")))

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")))
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{row}>>").alias("rows"))
    return F.flatten(F.aggregate(blocks, start, outer)["rows"])
