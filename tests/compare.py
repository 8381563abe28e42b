"""Comparing a query with its SQL, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    """Rows as sorted texts; whole numbers look alike, since a column with nulls turns them into floats."""
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(str([plain(x) for x in r]) for r in frame.where(frame.notna(), None).values.tolist())


def by_sql(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()
