"""Holding a query's rows against DuckDB's."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path
from typing import Any

import duckdb


def plain(x: Any) -> Any:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def rows_of_df(df) -> tuple[list[str], Counter]:  # noqa: ANN001
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def difference(df, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """What differs, or nothing."""
    (a, x), (b, y) = rows_of_df(df), rows_of_sql(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only in the query {[str(r)[:300] for r in (x - y)][:2]}, only in SQL {[str(r)[:300] for r in (y - x)][:2]}"
