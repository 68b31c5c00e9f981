"""A query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb

import __spark_entry__ as entry
from compare import rows_of


def differs(spark, name, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    plain = lambda rows: [tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r) for r in rows]
    df, rel = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"{df.columns} and {rel.columns}"
    mine, theirs = rows_of(df.columns, plain(df.collect())), rows_of(rel.columns, plain(rel.fetchall()))
    return None if mine == theirs else f"{len(mine)} and {len(theirs)} rows: {set(mine) ^ set(theirs)}"[:500]
