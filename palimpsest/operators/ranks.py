"""Positions and running sums over whole tables, in two steps, so that no window holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a hash (three hexadecimal digits), and cells of a column's quantiles.
HASH_CELLS, CELLS = 4_096, 256


def row_index(df: DataFrame, key: str, name: str = "idx", seed: int = 42) -> DataFrame:
    """df with ``name``: the place of each row in the order of md5(seed|key), key; from 0.

    Rows are numbered within the cells of the hash's first digits; the counts of the cells (at most
    HASH_CELLS rows, which the driver sees) say where each begins.
    """
    own = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_cell", F.substring("_h", 1, 3))
    at, rows = 0, []
    for r in sorted(own.groupBy("_cell").count().collect(), key=lambda r: r["_cell"]):
        rows.append((r["_cell"], at))
        at += r["count"]
    base = df.sparkSession.createDataFrame(rows, "_cell string, _base bigint")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key))
    return own.join(F.broadcast(base), "_cell").withColumn(name, (F.col("_base") + place - 1).cast("bigint")).drop("_h", "_cell", "_base")


def cut_points(df: DataFrame, column: str, cells: int) -> list[float]:
    """Values that part a column into about equal cells; every value of a column of few values."""
    at = df.agg(F.percentile_approx(column, [(i + 1) / cells for i in range(cells - 1)], 100 * cells)).first()[0]
    return sorted(set(at or []))


def cell_of(column: str, bounds: list[float]):
    """How many bounds lie under the value, by halving."""

    def find(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) > bounds[mid], find(mid + 1, hi)).otherwise(find(lo, mid))

    return find(0, len(bounds))


def running(steps: DataFrame, keys: list[str], order: str, columns: list[str], cells: int = CELLS) -> DataFrame:
    """steps (keys, order, columns), one row a value of ``order`` in a group, with before_<column>: its sum
    over the group's rows of lower ``order``. Groups are summed cell by cell, then over at most ``cells``."""
    own = steps.withColumn("_cell", cell_of(order, cut_points(steps, order, cells)))
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    base = sums.select(*keys, "_cell", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_base_{c}") for c in columns])
    own = own.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    a, b = own.alias("a"), base.alias("b")
    same = F.col("a._cell") == F.col("b._cell")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same)
    return both.select(*[F.col(f"a.{c}").alias(c) for c in steps.columns], *[(F.col(f"a.before_{c}") + F.col(f"b._base_{c}")).alias(f"before_{c}") for c in columns])
