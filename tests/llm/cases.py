"""What the tests of several operators share."""

import duckdb

SF = "/root/testdata/sf0.001"


def table(name, sf=SF):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def same_as_sql(spark, name):
    """Rows of a registered query against its SQL, by column name."""
    from waymark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    return got, sorted(want.fetchall(), key=repr)
