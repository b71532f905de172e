"""Summaries of attack-success, utility and dataset tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.metrics import wilson


def summarise_asr(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, asr, asr_ci_low, asr_ci_high, natural_retrieval_rate, detection_rate, escalation_rate,
    defense_ms_mean) of raw rows (success, poisoned_retrieved, detected, escalated, defense_ms)."""
    a = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("success").alias("_s"), F.avg("poisoned_retrieved").alias("natural_retrieval_rate"),
        F.avg("detected").alias("detection_rate"), F.avg((F.col("escalated") > 0).cast("int")).alias("escalation_rate"), F.avg("defense_ms").alias("defense_ms_mean"),
    )
    low, high = wilson(F.col("_s"), F.col("n"))
    return a.select(*keys, "n", (F.col("_s") / F.greatest(F.lit(1), F.col("n"))).alias("asr"), low.alias("asr_ci_low"), high.alias("asr_ci_high"), "natural_retrieval_rate", "detection_rate", "escalation_rate", "defense_ms_mean")


def describe(df: DataFrame, by: str = "domain") -> DataFrame:
    """(by, n, positives, positive_share, median_chars, p95_chars); by is NULL in the row of the whole."""
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("positive_share"),
        F.percentile(F.length("text"), 0.5).alias("median_chars"), F.percentile(F.length("text"), 0.95).alias("p95_chars"),
    )


def slug(name: Column) -> Column:
    """A name as part of a file's: lower case, letters and digits of any script, hyphens and dots kept,
    the rest hyphens."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}.-]", "-")

