"""Attacks that leak from training into evaluation: equal and nested texts after reduction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.normalize import canonicalize
from palimpsest.operators import filters
from palimpsest.operators.lineage import cut, keep

#: Counters of the windows by which a needle's rarest one is found.
SKETCH = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def reduce(text: Column) -> Column:
    """Lower-case Latin letters and digits of the canonical text, encoded blocks decoded."""
    return F.regexp_replace(F.lower(canonicalize(text)["text"]), "[^a-z0-9]+", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(reduce(text), 256)


def duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """(fingerprint, n) of texts that occur more than once."""
    return df.where(F.col(text).isNotNull()).groupBy(fingerprint(F.col(text)).alias("fingerprint")).count().where("count > 1").withColumnRenamed("count", "n")


def equal_leaks(held: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of held (text) whose fingerprint occurs in train (text)."""
    known = train.select(fingerprint(F.col("text")).alias("_f")).distinct()
    return held.withColumn("_f", fingerprint(F.col("text"))).join(known, "_f", "left_semi").drop("_f")


def _rolling(raw: bytes | memoryview, n: int) -> np.ndarray:
    """Hashes of every n bytes, modulo 2^64."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(b) - n + 1), np.uint64)
        for k in range(n):
            out = out * _FACTOR + b[k : k + len(out)]
        return out ^ (out >> np.uint64(29))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SKETCH)).astype(np.int64)


def _needle_rows(needles: DataFrame, least: int) -> DataFrame:
    """(h, at, size, f1, f2) of distinct needles: the window that is rarest among all needles, where it
    stands, and the needle's length and hashes. So a beginning that many share joins none of them."""
    spark = needles.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b.column("_needle").to_pylist():
                np.add.at(n, _cells(np.unique(_rolling(t.encode(), least))), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["cell", "n"])

    cells = needles.select("_needle").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, places = [], []
            for t in b.column("_needle").to_pylist():
                h = _rolling(t.encode(), least)
                at = int(np.lexsort((h, shared.value[_cells(h)]))[0])
                hashes.append(int(h.view(np.int64)[at]))
                places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), b.column("size"), b.column("f1"), b.column("f2")], ["h", "at", "size", "f1", "f2"])

    return needles.mapInArrow(rarest, "h bigint, at int, size int, f1 bigint, f2 bigint")


def _window_rows(shared, least: int, key: str):
    """(key, place, h) of the windows of haystacks that pass the filter; many texts are hashed at once, as
    they lie one after another, and windows that reach into the next text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for first in range(0, big.num_rows, 2_000):
                b = big.slice(first, 2_000)
                column = b.column("_hay").cast(pa.large_string())
                _, ends, data = column.buffers()
                ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
                h = _rolling(memoryview(data)[ends[0] : ends[-1]], least)
                at = np.flatnonzero(filters.passes(shared.value, h)) + ends[0]
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + least <= ends[row + 1]
                at, row = at[inside], row[inside]
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array((at - ends[row]).astype(np.int32)), pa.array(h[at - ends[0]].view(np.int64))], [key, "place", "h"])

    return run


def nested_leaks(held: DataFrame, key: str, train: DataFrame, train_key: str, least: int = fixed.NESTED_MIN, block: int = filters.BLOCK) -> DataFrame:
    """(key, train_key): reduced held texts of at least ``least`` characters inside reduced train texts.

    No pair is made blindly. One window of each distinct needle, its rarest, is kept in a filter that
    executors hold, sized from the needles and in blocks of bounded size; windows of haystacks that pass
    are joined by hash, with places and without texts; then each haystack with a hit meets its text once,
    and hashes of the whole needle decide (128 bits).
    """
    spark = held.sparkSession
    f = F.struct(F.xxhash64("_needle").alias("f1"), F.xxhash64(F.lit("needle"), F.col("_needle")).alias("f2"))
    # kept before they are filtered, else the filter would reduce every text a second time
    owners = keep(held.where(F.col("text").isNotNull()).select(F.col(key), reduce(F.col("text")).alias("_needle"))).where(F.length("_needle") >= least).withColumn("_f", f).select(key, "_needle", "_f.*")
    distinct = owners.groupBy("f1", "f2").agg(F.any_value("_needle").alias("_needle")).withColumn("size", F.length("_needle"))
    needles = cut(_needle_rows(distinct, least))
    blocks = max(1, -(-needles.count() // block))
    hay = keep(train.where(F.col("text").isNotNull()).select(F.col(train_key), reduce(F.col("text")).alias("_hay"))).where(F.length("_hay") >= least)
    kind = dict(train.dtypes)[train_key]
    found = None
    for i in range(blocks):
        own = needles.where(F.pmod("h", F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(filters.filter_of(own.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64)))  # about block of them
        hits = hay.mapInArrow(_window_rows(shared, least, train_key), f"{train_key} {kind}, place int, h bigint")
        met = hits.join(own, "h").select(train_key, (F.col("place") - F.col("at")).alias("start"), "size", "f1", "f2").where("start >= 0").distinct()
        found = met if found is None else found.unionByName(met)
    inside = F.substring(F.col("_hay"), F.col("start") + 1, F.col("size"))
    sure = found.join(hay, train_key).where((F.xxhash64(inside) == F.col("f1")) & (F.xxhash64(F.lit("needle"), inside) == F.col("f2")))
    return sure.select(train_key, "f1", "f2").distinct().join(owners.select(key, "f1", "f2"), ["f1", "f2"]).select(key, train_key).distinct()


def assert_disjoint(held: DataFrame, key: str, train: DataFrame, train_key: str) -> None:
    """Raises if a held text equals or lies inside a train text."""
    first = equal_leaks(held, train).select(key).limit(1).collect() or nested_leaks(held, key, train, train_key).limit(1).collect()
    if first:
        raise ValueError(f"held-out text {first[0][0]!r} occurs in the training texts")
