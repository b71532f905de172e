"""Dense retrieval without an index: blocks of queries against all rows; every Arrow batch sends on its own
best for each query. And what is built on it: pinning, the defended context, prompt and answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed

#: Bytes of query vectors that a pass over the corpus holds, and queries whose scores a task has at once.
QUERY_BYTES, QUERIES_AT_ONCE = 64 << 20, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    v = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _local_top(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        ids = np.asarray(ids)
        for b in batches:
            if not len(b):
                continue
            rows, own = _matrix(b["embedding"]), b["vec_id"].to_numpy()
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                q = ids[at : at + QUERIES_AT_ONCE]
                scores = np.round(matrix[at : at + QUERIES_AT_ONCE] @ rows.T, 12)
                scores[q[:, None] == own[None, :]] = -np.inf
                n = min(k, scores.shape[1])
                edge = np.partition(scores, -n, axis=1)[:, -n]
                near, place = np.nonzero(scores >= edge[:, None] - 1e-8)
                value = scores[near, place]
                order = np.lexsort((own[place], -np.round(value, 9), near))  # ties by the smaller id
                near, place, value = near[order], place[order], value[order]
                start = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
                rank = np.arange(len(near)) - np.repeat(start, np.diff(np.r_[start, len(near)]))
                best = (rank < k) & np.isfinite(value)
                yield pd.DataFrame({"query_id": q[near[best]], "vec_id": own[place[best]], "score": value[best]})

    return run


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[pd.DataFrame]:
    """The queries in pieces whose vectors take about QUERY_BYTES."""
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = -(-n * 8 * max(1, width or 1) // QUERY_BYTES)
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).toPandas()
        if len(part):
            yield part


def top_k(queries: DataFrame, corpus: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of all corpus rows (vec_id, embedding) to each query
    (vec_id, embedding), itself left out; ties by smaller id. NULL vectors are left out.
    """
    spark = queries.sparkSession
    found = None
    for part in _blocks(queries.where("embedding is not null").select("vec_id", "embedding"), "vec_id", "embedding"):
        shared = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(part["embedding"])))
        hits = corpus.where("embedding is not null").select("vec_id", "embedding").mapInPandas(_local_top(shared, k), "query_id bigint, vec_id bigint, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _count_near(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, own = shared.value
        counts = np.zeros(len(ids), np.int64)
        for b in batches:
            if len(b):
                rows, vec = _matrix(b["embedding"]), b["vec_id"].to_numpy()
                for at in range(0, len(ids), QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    scores = np.round(matrix[part] @ rows.T, 9)
                    counts[part] += ((scores >= np.round(own[part], 9)[:, None]) & (ids[part][:, None] != vec[None, :])).sum(axis=1)
        yield pd.DataFrame({"query_id": ids, "n": counts})

    return run


def count_nearer(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, rank): corpus rows at least as near to a query as its target, of targets (query_id, qe,
    own: the target's score); the query's own row is left out. Blocks as in top_k."""
    spark = targets.sparkSession
    found = spark.createDataFrame([], "query_id bigint, n bigint")
    for part in _blocks(targets.select("query_id", "qe", "own"), "query_id", "qe"):
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), _matrix(part["qe"]), part["own"].to_numpy()))
        found = found.unionByName(corpus.where("embedding is not null").select("vec_id", "embedding").mapInPandas(_count_near(shared), "query_id bigint, n bigint"))
    return found.groupBy("query_id").agg(F.sum("n").alias("rank")).where("rank > 0")


def pin(top: DataFrame, pinned: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """top (query_id, vec_id, rank) with each query's pinned id (query_id, pin_id): if it isn't there, it
    takes the last rank."""
    w = Window.partitionBy("query_id")
    rows = top.join(pinned, "query_id", "left").withColumn("_in", F.max((F.col("vec_id") == F.col("pin_id")).cast("int")).over(w))
    swap = (F.col("rank") == k) & (F.col("_in") == 0)
    return rows.select("query_id", F.when(swap, F.col("pin_id")).otherwise(F.col("vec_id")).alias("vec_id"), "rank")


def replace_row(corpus: DataFrame, vec_id, embedding: Column) -> DataFrame:
    """The corpus with one row's embedding overlaid."""
    return corpus.withColumn("embedding", F.when(F.col("vec_id") == vec_id, embedding).otherwise(F.col("embedding")))


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Answer from the passages only.\n\nPassages:\n"), context, F.lit("\n\nQuestion: "), query)


def retrieved(queries: DataFrame, corpus: DataFrame, k: int = fixed.TOP_K, pinned: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, text): the passages of each query (query_id, question, embedding) from a
    corpus (vec_id, embedding, text), with those pinned (query_id, pin_id) among them."""
    top = top_k(queries.select(F.col("query_id").alias("vec_id"), "embedding"), corpus, k)
    if pinned is not None:
        top = pin(top, pinned, k)
    return top.join(corpus.select("vec_id", "text"), "vec_id").select("query_id", "rank", "vec_id", "text")


def answer(queries: DataFrame, corpus: DataFrame, defend: Callable[[DataFrame], DataFrame], generate: Callable[[Column], Column], k: int = fixed.TOP_K, pinned: DataFrame | None = None) -> DataFrame:
    """(query_id, question, answer, retrieved, actions, context, escalated): retrieval, defence and answer.

    ``defend`` gives passages (query_id, rank, vec_id, text) their verdicts; what is blocked or blank is left
    out of the context. ``generate`` turns a prompt column into an answer column.
    """
    seen = defend(retrieved(queries, corpus, k, pinned))
    usable = (F.col("action") != "block") & F.col("clean_text").rlike("(?U)\\S")
    each = F.struct("rank", "vec_id", "action", "escalated", F.when(usable, F.col("clean_text")).alias("clean"))
    by = seen.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("p"))  # k rows at most
    kept = F.array_compact(F.transform("p", lambda x: x["clean"]))
    rows = queries.select("query_id", "question").join(by, "query_id", "left").withColumn("context", F.when(F.size(kept) > 0, F.array_join(kept, fixed.CONTEXT_SEPARATOR)).otherwise(fixed.NO_CONTEXT))
    return rows.select(
        "query_id", "question", F.trim(generate(prompt(F.col("context"), F.col("question")))).alias("answer"), F.transform("p", lambda x: x["vec_id"]).alias("retrieved"),
        F.transform("p", lambda x: x["action"]).alias("actions"), "context", F.aggregate("p", F.lit(0), lambda a, x: a + x["escalated"]).alias("escalated"),
    )
