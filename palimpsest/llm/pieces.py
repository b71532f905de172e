"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text over the limit is read as atomic segments: sentences and lines, the words of a sentence that
is too long itself, and runs of code points of a word that is too long. Adjacent segments wait in a
heap; the weakest boundary (word, sentence, line, paragraph) is merged away first, of equal ones the
pair with the smallest sum, as long as the result and the overlap fit the limit. What is left are
the pieces; each but the first begins up to ``overlap`` code points earlier, at the start of a word
where there is one. Pieces without their overlaps join to the text exactly.

Cases: NULL and empty texts, and texts within the limit, give no rows (they need no cut); a text
without any boundary is cut every ``limit - overlap`` code points, never before a combining mark
unless the marks alone exceed that; repeated rows of a key count once; a NULL key has no pieces.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.operators.tables import table

LIMIT, OVERLAP = 900, 150
#: Boundary strengths.
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)

_BREAK = re.compile(r"(?P<p>\s*\n[^\S\n]*\n\s*)|(?P<l>[^\S\n]*\n)|(?P<s>[.!?;…。！？]+[\"'»”’)\]]*[^\S\n]+)")
_SPACE = re.compile(r"\s+")
_WORD_START = re.compile(r"(?<=\s)\S")
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE}


def _hard_cuts(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """(end, strength) of runs of at most ``most`` code points."""
    out = []
    while end - start > most:
        at = start + most
        while at > start + 1 and unicodedata.combining(text[at]):
            at -= 1
        if at == start + 1:
            at = start + most
        out.append((at, CHARACTER))
        start = at
    return out


def segments(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at its end) of atomic segments of at most ``most``."""
    cuts = [(m.end(), _STRENGTH[m.lastgroup]) for m in _BREAK.finditer(text) if m.end() < len(text)]
    cuts.append((len(text), PARAGRAPH))
    out, start = [], 0
    for end, strength in cuts:
        if end - start > most:
            words = [(m.end(), WORD) for m in _SPACE.finditer(text, start, end) if m.end() < end] + [(end, strength)]
            for w_end, w_strength in words:
                for at, s in _hard_cuts(text, start, w_end, most):
                    out.append((start, at, s))
                    start = at
                out.append((start, w_end, w_strength))
                start = w_end
        else:
            out.append((start, end, strength))
            start = end
    return out


def _start_with_overlap(text: str, core: int, overlap: int) -> int:
    low = max(0, core - overlap)
    if low == 0 or overlap == 0 or text[low - 1].isspace() and not text[low].isspace():
        return low
    m = _WORD_START.search(text, low, core)
    return m.start() if m else low


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core, end) of the pieces of a text; text[core:end] are its parts without overlaps."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    atoms = segments(text, limit - overlap)
    start = [a[0] for a in atoms]
    end = [a[1] for a in atoms]
    strength = [a[2] for a in atoms]
    after = list(range(1, len(atoms))) + [-1]
    before = [-1, *range(len(atoms) - 1)]
    version = [0] * len(atoms)
    alive = [True] * len(atoms)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (whole := end[j] - start[i]) + (overlap if start[i] else 0) <= limit:
            heapq.heappush(heap, (strength[i], whole, i, version[i], version[j]))

    for i in range(len(atoms)):
        offer(i)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or version[i] != vi or version[j] != vj:
            continue
        end[i], strength[i], after[i] = end[j], strength[j], after[j]
        alive[j] = False
        if after[i] >= 0:
            before[after[i]] = i
        version[i] += 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out: list[tuple[int, int, int]] = []
    for i in (i for i in range(len(atoms)) if alive[i]):
        at = _start_with_overlap(text, start[i], overlap) if start[i] else 0
        if out and out[-1][0] >= at:  # the piece before would lie in this one
            out[-1] = (at, out[-1][1], end[i])
        else:
            out.append((at, start[i], end[i]))
    return out


def _points_udf(limit: int, overlap: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("core", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append(None if t is None else [{"start": s, "core": c, "end": e} for s, c, e in cut_points(t, limit, overlap)])
        return pa.array(out, kind)

    return arrow_udf(run, "array<struct<start:int,core:int,end:int>>")


def oversized(spark, folder: str, limit: int = LIMIT) -> DataFrame:
    """(tab, rec_id, text) of the records over the limit in clean_docs and chunks, once each."""
    parts = [
        table(spark, folder, t).where(F.length("text") > limit).select(F.lit(t).alias("tab"), F.col(k).alias("rec_id"), "text")
        for t, k in (("clean_docs", "doc_id"), ("chunks", "chunk_id"))
    ]
    return parts[0].unionByName(parts[1]).where("rec_id is not null")


def split_oversized(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tab, rec_id, position, pieces, start, core, end, text) for records (tab, rec_id, text).

    Only cut points come back from Python; the pieces are taken from the text in the JVM.
    """
    whole = records.where(F.length("text") > limit).groupBy("tab", "rec_id").agg(F.min("text").alias("text"))
    cuts = whole.withColumn("p", _points_udf(limit, overlap)(F.col("text")))
    rows = cuts.select("tab", "rec_id", "text", F.size("p").alias("pieces"), F.posexplode("p").alias("position", "x"))
    return rows.select(
        "tab", "rec_id", "position", "pieces", "x.start", "x.core", "x.end",
        F.col("text").substr(F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("text"),
    )


def found(pieces: DataFrame) -> DataFrame:
    """(tab, rec_id) of the records that were cut."""
    return pieces.where("position = 0 and pieces > 1").select("tab", "rec_id")


def piece_report(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(tab, records, pieces, longest, mean_fill): how well the pieces use the limit."""
    return pieces.groupBy("tab").agg(
        F.sum((F.col("position") == 0).cast("int")).alias("records"), F.count(F.lit(1)).alias("pieces"),
        F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")) / limit, 4).alias("mean_fill"),
    )
