"""Joins whose key may be held by a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins.
PER_TASK = 1_000_000


def join_on_unique(left: DataFrame, right: DataFrame, keys: list[str], n: str, per_task: int = PER_TASK) -> DataFrame:
    """left (keys, ...) inner joined with right (keys, n, ...), which has one row a key and in ``n`` about
    how many rows of left hold it.

    A key of more than ``per_task`` rows is spread: its rows on the left take one of as many salts as it
    needs tasks, by their hash, and its row on the right is there once for each. Such keys are at most
    rows / per_task, so their list is bounded and broadcast. ``right`` is read twice and should be kept.
    Columns of left but its keys must not be named as right's.
    """
    tasks = F.ceil(F.col(n) / per_task).cast("int")
    hot = right.where(F.col(n) > per_task).select(*keys, tasks.alias("_tasks"))
    salted = left.join(F.broadcast(hot), keys, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_tasks"))).cast("int")).drop("_tasks")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(tasks, F.lit(1)) - 1)))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
