"""Random draws as hashes of (seed, key, tag): the same on every engine, order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, tag: str, n: int | Column, seed: int = 42) -> Column:
    """An integer in [0, n)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % (F.lit(n) if isinstance(n, int) else n)


def draw_sql(key: str, tag: str, n: str, seed: int = 42) -> str:
    """The same draw in DuckDB's SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR), '{tag}')), 1, 8) AS BIGINT) % {n})"
