"""Compare a Spark result with the rows a SQL engine returns for the matching query."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def kind(value) -> str:
    for types, name in (((bool,), "bool"), ((int,), "int"), ((float,), "float"), ((Decimal,), "decimal"),
                        ((dt.date,), "date"), ((str,), "str")):
        if isinstance(value, types):
            return name
    return type(value).__name__


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: [(v is None, kind(v), v if v is not None else 0) for v in r])


def differences(spark_df, con, sql: str) -> list[str]:
    con.execute(f"CREATE OR REPLACE VIEW counterpart AS {sql}")  # a counterpart must also do as a view
    cursor = con.execute("SELECT * FROM counterpart")
    want_names, want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    names, got = sorted_rows(spark_df.columns, spark_df.collect())
    if names != want_names:
        return [f"columns {names} against {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}; only here {set(got) - set(want)}, only there {set(want) - set(got)}"[:1500]]
    found = []
    for a, b in zip(got, want, strict=True):
        if a != b or [kind(v) for v in a] != [kind(v) for v in b]:
            found.append(f"{dict(zip(names, a, strict=True))} against {dict(zip(names, b, strict=True))}"[:700])
    return found
