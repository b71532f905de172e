"""Problem 1's pairs: records of one table that differ in storage but show the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canon import form, key128
from palimpsest.operators.lineage import cut
from palimpsest.operators.tables import table

#: Table -> key and text column.
TEXTS = {"attacks": ("attack_id", "text"), "chunks": ("chunk_id", "text"), "verdicts": ("verdict_id", "canonical_text")}


def texts(spark, folder: str) -> DataFrame:
    """(tab, id, text) of the three tables; repeated rows are still there."""
    parts = [
        table(spark, folder, t).select(F.lit(t).alias("tab"), F.col(k).alias("id"), F.col(c).alias("text"))
        for t, (k, c) in TEXTS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def same_looking(records: DataFrame) -> DataFrame:
    """(tab, id_lo, id_hi) of records (tab, id, text) whose texts differ but have one form.

    Only hashes of texts are moved. Classes with a single stored text, however many copies it has,
    are dropped before any pair is made; then pairs of stored texts are made within each class, and
    only those are joined with their records, so no two copies of one text are ever compared. Rows
    with a NULL key or text have no pair; repeated rows of a key count once.
    """
    hashed = cut(
        records.where("id is not null and text is not null")
        .select("tab", "id", key128(form(F.col("text"))).alias("c"), key128(F.col("text")).alias("v"))
    )
    classes = hashed.groupBy("tab", "c").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b").select("tab", "c")
    members = cut(hashed.join(classes, ["tab", "c"], "left_semi").groupBy("tab", "id").agg(F.min(F.struct("c", "v")).alias("cv")).select("tab", "id", "cv.c", "cv.v"))
    variants = members.select("tab", "c", "v").distinct()
    pairs = variants.alias("x").join(
        variants.select("tab", "c", F.col("v").alias("w")).alias("y"), ["tab", "c"]
    ).where("v < w")
    left = members.select("tab", "c", "v", F.col("id").alias("id_a"))
    right = members.select("tab", "c", F.col("v").alias("w"), F.col("id").alias("id_b"))
    return (
        pairs.join(left, ["tab", "c", "v"]).join(right, ["tab", "c", "w"])
        .select("tab", F.least("id_a", "id_b").alias("id_lo"), F.greatest("id_a", "id_b").alias("id_hi"))
    )


def form_report(records: DataFrame) -> DataFrame:
    """(tab, records, changed, shorter): how many records of each table aren't stored in their form."""
    f = form(F.col("text"))
    return (
        records.where("id is not null").select("tab", "id", F.coalesce((f != F.col("text")).cast("int"), F.lit(0)).alias("ch"), F.coalesce((F.length(f) < F.length("text")).cast("int"), F.lit(0)).alias("sh"))
        .groupBy("tab", "id").agg(F.max("ch").alias("ch"), F.max("sh").alias("sh"))
        .groupBy("tab").agg(F.count(F.lit(1)).alias("records"), F.sum("ch").alias("changed"), F.sum("sh").alias("shorter"))
    )
