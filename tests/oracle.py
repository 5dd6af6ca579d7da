"""Runs a query and its oracle and compares their rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


def same(spark_frame, sql, connection):
    ours, theirs = spark_frame.toPandas(), connection.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
