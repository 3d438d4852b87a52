"""Rows of a Spark result and of DuckDB, in one comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def frame(spark_df):
    """A pandas frame whose whole numbers stay whole beside nulls."""
    whole = {c: "Int64" for c, t in spark_df.dtypes if t in ("int", "bigint")}
    return spark_df.toPandas().astype(whole)


def same(spark_df, con, sql):
    ours, theirs = frame(spark_df), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
