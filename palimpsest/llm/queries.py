"""The pN_ queries, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import abuse, leaks, ledger, overlap, packing, pairs, pieces, splits
from palimpsest.operators.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.same_looking(pairs.texts(spark, folder))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.form_report(pairs.texts(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.found(*splits.tables(spark, folder))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_chunks(*splits.tables(spark, folder))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    out = p2_splits(spark, folder)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("group").alias("groups"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.found(spark, folder)


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.records(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.found(p4_pieces(spark, folder))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(pieces.oversized(spark, folder))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_report(p4_pieces(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found(overlap.overlaps(overlap.records(spark, folder)))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(overlap.overlaps(overlap.records(spark, folder)))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.found(p6_contexts(spark, folder))


def p6_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return packing.contexts(table(spark, folder, "documents"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(p6_contexts(spark, folder))


def _documents_and_items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents"), table(spark, folder, "eval_items")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(*_documents_and_items(spark, folder))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.spans(*_documents_and_items(spark, folder))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.cleaned(*_documents_and_items(spark, folder))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(*_documents_and_items(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found(abuse.scores_of(spark, folder))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores_of(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(abuse.scores_of(spark, folder))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT DISTINCT 'clean_docs' AS tab, doc_id AS rec_id FROM clean_docs WHERE length(text) > 900
            UNION ALL SELECT DISTINCT 'chunks', chunk_id FROM chunks WHERE length(text) > 900""",
    }
