"""S1: weighted patterns with spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed

NAMES = tuple(r[0] for r in fixed.RULES)
JAVA = {name: "(?imU)" + pattern for name, _, _, pattern in fixed.RULES}


def fires(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(JAVA[name]), F.lit(False))


def rule_score(text: Column) -> Column:
    """The largest weight of the rules that fire; 0 if none does or the text is NULL."""
    return F.greatest(F.lit(0.0), *[F.when(fires(text, n), F.lit(w)).otherwise(0.0) for n, w, _, _ in fixed.RULES])


def fired(text: Column) -> Column:
    """Names of the rules that fire, comma-separated, in their order."""
    return F.concat_ws(",", *[F.when(fires(text, n), F.lit(n)) for n in NAMES])


def found(text: Column, name: str) -> Column:
    """All non-overlapping matches, NULL where the rule doesn't fire: the pattern is looked for first and
    extracted only where it fires. Kept as a column, it serves score, names and spans."""
    return F.when(fires(text, name), F.regexp_extract_all(text, F.lit(JAVA[name]), F.lit(0)))


def score_of(hits: dict[str, Column]) -> Column:
    """rule_score() of found() columns."""
    return F.greatest(F.lit(0.0), *[F.when(hits[n].isNotNull(), F.lit(w)).otherwise(0.0) for n, w, _, _ in fixed.RULES])


def fired_of(hits: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(hits[n].isNotNull(), F.lit(n)) for n in NAMES])


def matches(text: Column, name: str) -> Column:
    """All non-overlapping matches, none where the rule doesn't fire."""
    return F.coalesce(found(text, name), F.array().cast("array<string>"))


def line_end(text: Column, at: Column) -> Column:
    """Offset of the next line break at or after ``at``, or the text's length."""
    rest = F.substring(text, at + 1, F.length(text))
    found = F.instr(rest, "\n")
    return F.when(found > 0, at + found - 1).otherwise(F.length(text))


def _block_end(text: Column, start: Column, end: Column) -> Column:
    """A marker's block: its line, and the next one if the marker opens a short line of its own and no
    blank line follows."""
    stop = line_end(text, end)
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    line = F.length(before) + stop - start
    own = ~before.rlike("(?U)\\S") & (line <= fixed.BLOCK_NEXT_LINE_MAX) & (stop < F.length(text)) & (F.substring(text, stop + 2, F.lit(1)) != "\n")
    return F.when(own, line_end(text, stop + 1)).otherwise(stop)


def spans(text: Column, name: str, hits: Column | None = None) -> Column:
    """array<struct<start,end>> of a rule's matches, in code points, half-open; ``hits`` are its found()."""
    scope = next(s for n, _, s, _ in fixed.RULES if n == name)
    hits = found(text, name) if hits is None else hits
    gaps = F.split(text, JAVA[name], -1)  # what lies between matches; one more than matches
    # Java drops an empty leading piece only for empty matches, which no rule has
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        stop = _block_end(text, start, end) if scope == "block" else end
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("end")))).alias("out"))

    return F.when(hits.isNotNull(), F.aggregate(pieces, zero, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def all_spans(text: Column, hits: dict[str, Column] | None = None) -> Column:
    return F.array_sort(F.flatten(F.array(*[spans(text, n, hits[n] if hits else None) for n in NAMES])))
