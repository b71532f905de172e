"""Span algebra on arrays of struct(start, end), half-open, in code points."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.functions import fixed

SPANS = "array<struct<start:int,end:int>>"


def overlap(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def merge(spans: Column) -> Column:
    """Sorted spans, overlapping and adjacent ones joined; NULL gives none."""
    empty = F.array().cast(SPANS)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.coalesce(F.array_sort(spans.cast(SPANS)), empty), empty, step)


def covered(spans: Column) -> Column:
    """Code points under merged spans."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def line_bounds(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of the lines that a span touches."""
    before = F.substring(text, F.lit(1), start)
    left = start - F.length(F.substring_index(before, "\n", -1))
    # the last character of the span that isn't blank decides, so a span that ends a line stays in it
    inside = F.substring(text, start + 1, end - start)
    anchor = F.greatest(start, start + F.length(F.regexp_replace(inside, "\\s+$", "")) - 1)
    hit = F.instr(F.substring(text, anchor + 1, F.length(text)), "\n")
    return left, F.when(hit > 0, anchor + hit).otherwise(F.length(text))


def sentence_bounds(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    before = F.substring(text, F.lit(1), start)
    left = start - F.length(F.regexp_extract(before, "[^.!?\\n]*$", 0))
    inside = F.substring(text, start + 1, end - start)
    anchor = F.greatest(start, start + F.length(F.regexp_replace(inside, "\\s+$", "")) - 1)
    upto = F.regexp_extract(F.substring(text, anchor + 1, F.length(text)), "^[^.!?\\n]*[.!?\\n]", 0)
    return left, F.when(upto != "", anchor + F.length(upto)).otherwise(F.length(text))


def expand(text: Column, spans: Column, max_line: int = fixed.MAX_LINE, max_share: float = fixed.MAX_LINE_SHARE) -> Column:
    """Spans grown to their lines, or to their sentences where the lines are long or most of the text."""

    def grow(s: Column) -> Column:
        left, right = line_bounds(text, s["start"], s["end"])
        s_left, s_right = sentence_bounds(text, s["start"], s["end"])
        wide = (right - left > max_line) | (right - left > max_share * F.length(text))
        a, b = F.when(wide, s_left).otherwise(left), F.when(wide, s_right).otherwise(right)
        return F.struct(a.cast("int").alias("start"), F.least(F.greatest(b, s["end"]), F.length(text)).cast("int").alias("end"))

    return merge(F.transform(spans, grow))


def redact(text: Column, merged: Column, marker: str = fixed.MARKER) -> Column:
    """The text with each merged span replaced by a marker."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        merged, zero,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(marker)).alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitize(text: Column, merged: Column, marker: str = fixed.MARKER, least: float = fixed.MIN_KEPT_SHARE) -> Column:
    """struct(clean, action): 'sanitize', or 'block' with '' if no span is given or too little is kept."""
    kept = (F.length(text) - covered(merged)) / F.length(text)
    blocked = (F.size(merged) == 0) | (F.length(text) == 0) | (kept < least)
    return F.when(blocked, F.struct(F.lit("").alias("clean"), F.lit("block").alias("action"))).otherwise(F.struct(redact(text, merged, marker).alias("clean"), F.lit("sanitize").alias("action")))


def struck(text: Column, merged: Column) -> Column:
    """The text as HTML, what the merged spans cover struck through."""

    def escape(x: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(sign), F.lit(name))
        return x

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept, gone = F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], escape(kept), F.lit("<del>"), escape(gone), F.lit("</del>")).alias("out"))

    done = F.aggregate(merged, zero, step)
    return F.concat(done["out"], escape(F.substring(text, done["at"] + 1, F.length(text))))


_PIECE = re.compile(r"[^\n.!?]+[\n.!?]*")


def _segments_at(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        out.append(None if t is None else [{"start": m.start(), "end": m.end(), "text": m.group()} for m in _PIECE.finditer(t) if m.end() - m.start() >= fixed.MIN_SEGMENT])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))


def segments_at(text: Column) -> Column:
    """array<struct<start,end,text>> of the segments; NULL for NULL. Offsets are summed in an Arrow batch,
    since arrays that grow by one in the JVM cost the square of their length."""
    return arrow_udf(_segments_at, "array<struct<start:int,end:int,text:string>>")(text)


def segments(text: Column) -> Column:
    """Sentence-like pieces of at least the smallest length."""
    return F.filter(F.regexp_extract_all(text, F.lit("[^\\n.!?]+[\\n.!?]*"), F.lit(0)), lambda s: F.length(s) >= fixed.MIN_SEGMENT)
