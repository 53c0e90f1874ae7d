"""A query's rows against its SQL's."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str:
    """What differs, or nothing."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(columns)}"
    mine, other = rows_of(spark_df.columns, spark_df.collect()), rows_of(columns, found.fetchall())
    if mine != other:
        extra, missing = [x for x in mine if x not in set(other)][:3], [x for x in other if x not in set(mine)][:3]
        return f"{len(mine)} and {len(other)} rows; only here {extra}; only in SQL {missing}"
    return ""
