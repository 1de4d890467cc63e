"""Rows of a query and of its SQL, made comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return columns, sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in rows)


def same(spark, query, sql, sf_dir):
    assert plain(query(spark, sf_dir).toPandas()) == plain(database(sf_dir).execute(sql).df())
