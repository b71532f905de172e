"""Evaluation texts leaking into training text.

The runs of LEAK words of all held-out items, hashed twice, make the set that every executor holds: a
hash filter sized from their number, 64 bits a run, so that less than 0.1 % of other windows pass (two
probes, each of at most one bit in 32). Of more than filters.BLOCK runs there is a filter for each block, and
the words of the documents, kept in the shared folder, are scanned against one after another, so
what an executor holds is 64 MB at most. Each document's word windows are scanned
with a rolling hash; what passes is verified by joining both hashes with the items' runs. Words are runs of letters and digits in problem-1 form and
lower case, whatever stands between them.

Cases: NULL or empty texts, and texts or items of fewer than LEAK words, hold nothing; NULL keys are
left out; a passage found several times gives one row per (document, item) in found() and one per
run in spans(); repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canon import NEEDS_FORM, folded, transducer, words_of
from palimpsest.operators import filters
from palimpsest.operators.lineage import cut, keep

#: Consecutive words that make a leak.
LEAK = 14
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Polynomial hashes of every n words in a row (of 64-bit word hashes), modulo 2^64."""
    w = words.view(np.uint64)
    if len(w) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(factor) + w[k : len(w) - n + 1 + k]
        return out ^ (out >> np.uint64(31))


def _windows(key: str, n: int, keep=None):
    """(key, place, g1, g2) of the windows of batches (key, words); ``keep`` tells which first hashes stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep() if keep else None
        for batch in batches:
            column = batch.column("words")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            if len(flat) < n:
                continue
            g1 = window_hashes(flat, n, _FACTORS[0])  # windows across documents are dropped below
            at = np.flatnonzero(passes(g1)) if passes else np.arange(len(g1))
            row = np.searchsorted(offsets, at + offsets[0], "right") - 1
            inside = at + offsets[0] + n <= offsets[row + 1]
            at, row = at[inside], row[inside]
            if len(at):
                g2 = window_hashes(flat, n, _FACTORS[1])[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(row)), pa.array((at + offsets[0] - offsets[row]).astype(np.int32)), pa.array(g1[at].view(np.int64)), pa.array(g2.view(np.int64))],
                    [key, "place", "g1", "g2"],
                )

    return run


def _words(rows: DataFrame, key: str) -> DataFrame:
    known = rows.where(f"{key} is not null and text is not null")
    return known.select(key, F.transform(words_of(folded(F.col("text"))), lambda w: F.xxhash64(w)).alias("words"))


def item_windows(items: DataFrame, n: int = LEAK) -> DataFrame:
    """(item_id, at, g1, g2): every run of n words of the held-out items (item_id, text)."""
    kind = "item_id bigint, place int, g1 bigint, g2 bigint"
    return cut(_words(items, "item_id").mapInArrow(_windows("item_id", n), kind).withColumnRenamed("place", "at").distinct())


def hits(documents: DataFrame, items: DataFrame, n: int = LEAK, block: int = filters.BLOCK) -> DataFrame:
    """(doc_id, item_id, place, at): word positions in documents and items where n words agree."""
    spark = documents.sparkSession
    runs = item_windows(items, n)
    blocks = max(1, -(-runs.count() // block))
    words = _words(documents, "doc_id")
    if blocks > 1:
        words = keep(words)
    found_ = None
    for i in range(blocks):
        own = runs.where(F.pmod("g1", F.lit(blocks)) == i)
        first = own.select("g1").distinct().toArrow()["g1"].to_numpy()  # about block of them
        shared = spark.sparkContext.broadcast(filters.filter_of(first.view(np.uint64)))
        scanned = words.mapInArrow(_windows("doc_id", n, lambda s=shared: lambda g: filters.passes(s.value, g)), "doc_id bigint, place int, g1 bigint, g2 bigint")
        met = scanned.join(own, ["g1", "g2"]).select("doc_id", "item_id", "place", "at")
        found_ = met if found_ is None else found_.unionByName(met)
    return found_


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents and the held-out items they hold."""
    return hits(documents, items).select("doc_id", "item_id").distinct()


def spans(documents: DataFrame, items: DataFrame, n: int = LEAK) -> DataFrame:
    """(doc_id, item_id, first_word, words): maximal runs of an item's words in a document.

    Positions that follow one another in both texts are one run; a run's key is their difference, so
    no group is larger than an item.
    """
    each = hits(documents, items, n).distinct().withColumn("d", F.col("place") - F.col("at"))
    place = F.array_sort(F.collect_set("place"))
    grouped = each.groupBy("doc_id", "item_id", "d").agg(place.alias("p"))
    starts = F.filter(F.col("p"), lambda x: ~F.array_contains(F.col("p"), x - 1))
    ends = F.filter(F.col("p"), lambda x: ~F.array_contains(F.col("p"), x + 1))
    rows = grouped.select("doc_id", "item_id", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"))
    return rows.select("doc_id", "item_id", F.col("x.s").alias("first_word"), (F.col("x.e") - F.col("x.s") + n).alias("words"))


def remove_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the given runs (first word, number of words) of its folded words."""
    t = transducer()
    pieces: list[tuple[str, int, int]] = []
    at = 0
    for m in t.pattern.finditer(text) if re.search(NEEDS_FORM, text) else ():
        pieces += [(c, i, i + 1) for i, c in enumerate(text[at : m.start()], at)]
        pieces.append((m.group(), m.start(), m.end()))
        at = m.end()
    pieces += [(c, i, i + 1) for i, c in enumerate(text[at:], at)]
    chars, origin = [], []
    for s, a, b in pieces:
        f = t.fold(s) if len(s) > 1 or not s.isascii() else s.lower()
        chars.append(f)
        origin += [(a, b)] * len(f)
    words = [m.span() for m in re.finditer(r"[^\W_]+", "".join(chars))]
    gone = [(origin[words[i][0]][0], origin[words[min(i + k, len(words)) - 1][1] - 1][1]) for i, k in runs if i < len(words)]
    out, at = [], 0
    for a, b in sorted(gone):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return "".join(out) + text[at:]


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, removed): the documents that hold passages, without them."""
    leaks = spans(documents, items).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "words")).alias("runs"))  # at most the words of the document
    once = documents.where("doc_id is not null").select("doc_id", "text").join(leaks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "runs")).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [remove_words(t, [(r["first_word"], r["words"]) for r in runs]) for t, runs in zip(b["text"], b["runs"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": new, "removed": [len(t) - len(x) for t, x in zip(b["text"], new)]})

    return once.select("doc_id", "x.text", "x.runs").mapInPandas(run, "doc_id bigint, text string, removed int")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents each leaked item is in."""
    return found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
