"""Sources and sinks: typed readers for the file formats of the domain; writers return what they wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed


def read_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_text(value: Column, is_list: bool) -> Column:
    """A list of lines or a single value, as text."""
    return F.array_join(value, "\n") if is_list else value.cast("string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, meta) of JSON lines; every key but id and text goes to meta, as text; blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    m = F.from_json("value", "map<string,string>")
    return raw.select(m.alias("m")).select(F.col("m")["id"].alias("id"), F.col("m")["text"].alias("text"), F.map_filter("m", lambda k, v: ~k.isin("id", "text")).alias("meta"))


def write_corpus(df: DataFrame, path: str) -> DataFrame:
    """JSON lines of (id, text, meta), meta's keys beside id and text."""
    flat = F.map_concat(F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("text"), F.col("text")), F.coalesce("meta", F.expr("cast(map() as map<string,string>)")))
    df.select(F.to_json(flat).alias("value")).write.mode("overwrite").text(path)
    return read_corpus(df.sparkSession, path)


def clean_only(corpus: DataFrame) -> DataFrame:
    """Documents not marked as poisoned; no mark counts as clean."""
    return corpus.where(F.coalesce(F.col("meta")["poisoned"], F.lit("0")) != "1")


def read_labelled_array(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a JSON array of {prompt, label}."""
    rows = spark.read.schema("prompt string, label int").json(path, multiLine=True)
    return rows.select(F.col("prompt").alias("text"), "label")


def read_attacks(spark: SparkSession, path: str, kind: str, split: str) -> DataFrame:
    """(attack_id, category, text) of a JSON object of category -> texts."""
    raw = spark.read.text(path, wholetext=True)
    by = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "texts"))
    rows = by.select("category", F.posexplode("texts").alias("i", "text"))
    return rows.select(F.concat_ws("-", F.lit(kind), F.lit(split), "category", "i").alias("attack_id"), "category", "text")


def probe(df: DataFrame, column: str, kind: str = "string") -> Column:
    """A column if df has it, else NULL."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def text_of(df: DataFrame, column: str) -> Column:
    """A column as text, whether it holds a value or a list of lines; NULL where df lacks it."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return as_text(F.col(column), kinds[column] == "array") if column in kinds else F.lit(None).cast("string")


def read_articles(spark: SparkSession, path: str, order: str, question: str, context: str = "document", most: int = 2_000) -> DataFrame:
    """(id, context, question) of a parquet file: the first ``most`` rows by ``order``, with one question."""
    rows = spark.read.parquet(path).orderBy(order).limit(most)
    return rows.select(F.col(order).cast("string").alias("id"), F.col(context).alias("context"), F.lit(question).alias("question"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(at, context, question, error) of JSON lines; lists are lines of text, and ``at`` orders the rows as the
    files and their lines do."""
    raw = spark.read.json(path)
    at = F.concat_ws("|", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 16, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return raw.select(at.alias("at"), *[text_of(raw, c).alias(c) for c in ("context", "question", "error")])


def read_documents(sources: dict[str, DataFrame], split: str, order: str, most: int | None = fixed.MAX_DOCS_PER_DOMAIN, least_chars: int = fixed.LEAST_CHARS) -> DataFrame:
    """(doc_id, domain, text, question) of raw tables by domain, with context and, where they have them,
    question and error.

    Of each domain the first ``most`` rows by ``order`` are taken, then short texts are left out; doc_id
    is domain, split and the row's place among the first (or, if all are taken, ``order``). A question that is missing or empty is the error, or a stock one.
    """
    parts = []
    for domain, df in sources.items():
        rows, place = df, F.col(order).cast("string")
        if most is not None:  # so this window is over ``most`` rows
            rows = df.orderBy(order).limit(most)
            place = (F.row_number().over(Window.orderBy(order)) - 1).cast("string")
        first = F.coalesce(F.nullif(text_of(df, "question"), F.lit("")), F.nullif(text_of(df, "error"), F.lit("")), F.lit("Answer the question."))
        parts.append(rows.select(F.concat_ws("-", F.lit(domain), F.lit(split), place).alias("doc_id"), F.lit(domain).alias("domain"), text_of(df, "context").alias("text"), F.substring(first, 1, fixed.QUERY_MAX).alias("question")))
    return reduce(DataFrame.unionByName, parts).where(F.length(F.regexp_replace("text", "^\\s+|\\s+$", "")) >= least_chars)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array of df's rows, in one file: a report of bounded size, such as hard cases."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(line.alias("x")).agg(F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("x")), ",\n"), F.lit("\n]")).alias("value"))
    rows.write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csvs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV files of one schema, whatever was inferred when they were written."""
    return spark.read.schema(schema).csv(paths, header=True, escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet by a column; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows; columns that one side lacks are NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def union_relaxed(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows; a column whose types differ becomes DOUBLE if both are numbers, else STRING."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    casts = {c: "double" if ta[c] in numbers and tb[c] in numbers else "string" for c in ta if c in tb and ta[c] != tb[c]}
    widen = lambda d: d.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
    return widen(a).unionByName(widen(b))
