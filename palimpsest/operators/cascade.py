"""The staged inspection: S0 canonical text, S1 rules, S2 classifier, S3 judge, then redaction.

Every stage is a column; a plug-in (classifier, judge) gets NULL for rows already decided, so a
costly one works only where it is asked. Decision order: rules at or over their threshold decide;
without a classifier the rest passes; a score under tau_lo passes, over tau_hi decides; the band
between, both ends included, passes without a judge and else follows it, always with S2's score.

What is removed are the rules' spans. Where S2 or S3 decides and no rule fired, the text is narrowed:
its segments are scored, those over tau_hi are removed, and the whole text only if it has fewer than
two segments or none is over. A row's segments are scored as an array, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.functions import fixed, normalize, rules, spans

#: (text) -> whether it is an injection. NULL text gives NULL.
Judge = Callable[[Column], Column]


@dataclass(frozen=True)
class Scorer:
    """A classifier: scores in [0, 1] of an input column, and of an array of inputs. NULL gives NULL."""

    one: Callable[[Column], Column]
    many: Callable[[Column], Column]


def columnwise(score: Callable[[Column], Column]) -> Scorer:
    """A classifier made of built-in expressions."""
    return Scorer(score, lambda texts: F.transform(texts, score))


def batched(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Scorer:
    """A model that scores lists of texts. ``load`` makes it, once in a Python process; it is asked for
    ``batch`` texts at a time, whatever rows they come from. A score that isn't a number counts as 1."""
    held: list = []

    def scores(texts: list[str]) -> np.ndarray:
        if not held:
            held.append(load())
        out = [np.asarray(held[0](texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
        return np.nan_to_num(np.concatenate(out), nan=1.0) if out else np.zeros(0)

    def one(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        at = iter(scores([t for t in given if t is not None]).tolist())
        return pa.array([None if t is None else next(at) for t in given], pa.float64())

    def many(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        at = iter(scores([t for ts in given if ts is not None for t in ts]).tolist())
        return pa.array([None if ts is None else [next(at) for _ in ts] for ts in given], pa.list_(pa.float64()))

    return Scorer(lambda text: arrow_udf(one, "double")(text), lambda texts: arrow_udf(many, "array<double>")(texts))


def positive_index(names: dict[int, str], known: tuple[str, ...] = fixed.POSITIVE_NAMES) -> int:
    """Which output of a model is the injection: the first of a known name, else the last."""
    return next((int(i) for i in sorted(names) if str(names[i]).upper() in known), len(names) - 1)


def decide(rule: Column, s2: Column | None, judged: Column | None, decide_at: float = fixed.RULES_DECIDE, lo: float = fixed.TAU_LO, hi: float = fixed.TAU_HI) -> Column:
    """struct(stage, bad, score)."""

    def out(stage: str, bad, score) -> Column:
        return F.struct(F.lit(stage).alias("stage"), (bad if isinstance(bad, Column) else F.lit(bad)).alias("bad"), score.cast("double").alias("score"))

    d = F.when(rule >= decide_at, out("S1", True, rule))
    if s2 is None:
        return d.otherwise(out("S1", False, rule))
    d = d.when(s2 < lo, out("S2", False, s2)).when(s2 > hi, out("S2", True, s2))
    if judged is None:
        return d.otherwise(out("S2", False, s2))
    return d.otherwise(out("S3", F.coalesce(judged, F.lit(True)), s2))


def judge_reply(answer: Column) -> Column:
    """Whether a judge's answer means an injection; anything but a clear SAFE does."""
    a = F.upper(F.coalesce(answer, F.lit("")))
    return a.contains("INJECTION") | ~a.contains("SAFE")


def judged_in_windows(judge: Judge, text: Column, size: int = fixed.JUDGE_MAX) -> Column:
    """Whether a judge that reads ``size`` code points finds an injection in any window of the text.

    ``judge`` is a column of built-in expressions; one that calls a model gets its windows from the
    caller. NULL gives NULL; an empty text is one window.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(text.isNotNull(), F.exists(starts, lambda i: judge(F.substring(text, i + 1, F.lit(size)))))


def classifier_input(text: Column, query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) != "", F.concat(query, F.lit(fixed.PAIR_SEPARATOR), text)).otherwise(text)


def localize(text: Column, pieces: Column, scores: Column, hi: float) -> Column:
    """Spans of the pieces (spans.segments_at) whose scores are over ``hi``; of the whole text if there are
    fewer than two or none is over."""
    over = F.filter(F.arrays_zip(pieces.alias("p"), scores.alias("s")), lambda x: x["s"] > hi)
    own = F.transform(over, lambda x: F.struct(x["p"]["start"].alias("start"), x["p"]["end"].alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when((F.size(pieces) < 2) | (F.size(own) == 0), whole).otherwise(own)


def _asked(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that the optimiser leaves as it is. A Python function over columns that another one
    helped to make would else have the expressions between them copied into each of its inputs."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def inspect(
    df: DataFrame, text: str = "text", query: str | None = None, classifier: Scorer | None = None, judge: Judge | None = None,
    policy: str = "sanitize", decide_at: float = fixed.RULES_DECIDE, lo: float = fixed.TAU_LO, hi: float = fixed.TAU_HI,
    use_query: bool = True, canonical: bool = False, marker: str = fixed.MARKER, least: float = fixed.MIN_KEPT_SHARE,
) -> DataFrame:
    """df with action, score, decided_by, canonical_text, clean_text, spans, flags, fired, escalated, trace.

    NULL texts are inspected as empty ones. Columns of df keep their names; a verdict column that df
    already has is replaced. ``canonical`` says that texts have been through S0. ``trace`` has one entry for
    each stage that ran, (stage, score, spans, detail); a column has no clock, so it holds no latency.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    if canonical:
        staged = df.withColumn("_t", given).withColumn("_flags", F.lit(""))
    else:
        staged = df.withColumn("_canon", normalize.canonicalize(given)).withColumn("_t", F.col("_canon.text")).withColumn("_flags", normalize.flags(F.col("_canon")))
    # one column a rule, matched once; what follows reads these
    staged = staged.withColumns({f"_hit_{n}": rules.found(F.col("_t"), n) for n in rules.NAMES})
    hits = {n: F.col(f"_hit_{n}") for n in rules.NAMES}
    staged = staged.withColumn("_rule", rules.score_of(hits)).withColumn("_fired", rules.fired_of(hits))
    s2 = judged = None
    q = F.col(query) if query and use_query else F.lit(None).cast("string")
    if classifier is not None:
        staged = _asked(staged, "_open", F.when(F.col("_rule") < decide_at, classifier_input(F.col("_t"), q))).withColumn("_s2", classifier.one(F.col("_open")))
        s2 = F.col("_s2")
        if judge is not None:
            staged = _asked(staged, "_gray", F.when(s2.between(lo, hi), F.col("_t"))).withColumn("_j", judge(F.col("_gray")))
            judged = F.col("_j")
    staged = staged.withColumn("_d", decide(F.col("_rule"), s2, judged, decide_at, lo, hi))
    bad = F.col("_d.bad")
    staged = staged.withColumn("_own", F.when(F.col("_fired") != "", rules.all_spans(F.col("_t"), hits)))
    base = F.col("_own")
    if classifier is not None:
        staged = _asked(staged, "_lost", F.when(bad & F.col("_own").isNull(), F.col("_t"))).withColumn("_pieces", spans.segments_at(F.col("_lost")))
        staged = _asked(staged, "_inputs", F.transform(F.when(F.size("_pieces") > 1, F.col("_pieces")), lambda p: classifier_input(p["text"], q)))
        staged = staged.withColumn("_over", classifier.many(F.col("_inputs")))
        base = F.coalesce(F.col("_own"), localize(F.col("_t"), F.col("_pieces"), F.col("_over"), hi))
    staged = staged.withColumn("_spans", F.when(bad, spans.expand(F.col("_t"), spans.merge(base))))
    clean = F.struct(F.lit("").alias("clean"), F.lit("block").alias("action")) if policy == "block" else spans.sanitize(F.col("_t"), F.col("_spans"), marker, least)
    staged = staged.withColumn("_c", F.when(bad, clean).otherwise(F.struct(F.col("_t").alias("clean"), F.lit("pass").alias("action"))))
    none = F.array().cast(spans.SPANS)

    def stage(name: str, score: Column, detail: Column, own: Column = none) -> Column:
        return F.struct(F.lit(name).alias("stage"), score.cast("double").alias("score"), own.alias("spans"), detail.alias("detail"))

    steps = [stage("S0", F.lit(0.0), F.col("_flags")), stage("S1", F.col("_rule"), F.col("_fired"), F.coalesce("_own", none))]
    if s2 is not None:
        steps.append(F.when(s2.isNotNull(), stage("S2", s2, F.lit(""))))
    if judged is not None:
        flagged = F.col("_d.stage") == "S3"
        steps.append(F.when(flagged, stage("S3", bad.cast("double"), F.when(bad, "INJECTION").otherwise("SAFE"))))
    out = {
        "action": F.col("_c.action"), "score": F.col("_d.score"), "decided_by": F.col("_d.stage"), "canonical_text": F.col("_t"),
        "clean_text": F.col("_c.clean"), "spans": F.coalesce("_spans", none), "flags": F.col("_flags"),
        "fired": F.col("_fired"), "escalated": (F.col("_d.stage") == "S3").cast("int"), "trace": F.array_compact(F.array(*steps)),
    }
    return staged.withColumns(out).drop("_canon", "_t", "_flags", *[f"_hit_{n}" for n in rules.NAMES], "_rule", "_fired", "_open", "_s2", "_gray", "_j", "_d", "_own", "_lost", "_pieces", "_inputs", "_over", "_spans", "_c")


CONFIGURATIONS = ("none", "s1", "s1_s2", "full")


def defend(df: DataFrame, configuration: str, classifier: Scorer, judge: Judge, text: str = "text", **settings) -> DataFrame:
    """inspect() with the stages of a configuration; 'none' passes every text on as it is, uninspected:
    without a score, stage or trace."""
    if configuration == "none":
        t, nothing = F.coalesce(F.col(text), F.lit("")), F.lit(None)
        return df.withColumns({
            "action": F.lit("pass"), "score": nothing.cast("double"), "decided_by": nothing.cast("string"), "canonical_text": t, "clean_text": t,
            "spans": F.array().cast(spans.SPANS), "flags": F.lit(""), "fired": F.lit(""), "escalated": F.lit(0),
            "trace": F.array().cast("array<struct<stage:string,score:double,spans:array<struct<start:int,end:int>>,detail:string>>"),
        })
    stages = {"s1": {}, "s1_s2": {"classifier": classifier}, "full": {"classifier": classifier, "judge": judge}}[configuration]
    return inspect(df, text, **stages, **settings)


def defended_context(inspected: DataFrame, key: str, rank: str, separator: str = fixed.CONTEXT_SEPARATOR, empty: str = fixed.NO_CONTEXT) -> DataFrame:
    """(key, context): clean passages that aren't blocked or blank, in order of rank."""
    usable = F.when((F.col("action") != "block") & (F.trim("clean_text") != ""), F.struct(F.col(rank), F.col("clean_text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(usable)), lambda x: x["clean_text"]), separator)
    return inspected.groupBy(key).agg(F.when(joined == "", F.lit(empty)).otherwise(joined).alias("context"))


def explain(score: Column, action: Column, stage: Column) -> Column:
    """A verdict in words."""
    number = F.when(score == 0, "0").when(score < 0.001, F.format_string("%.1e", score)).otherwise(F.format_string("%.3f", F.round(score, 3)))
    what = F.when(action == "pass", "passed").when(action == "sanitize", "was cleaned").otherwise("was blocked")
    return F.concat(F.lit("The passage "), what, F.lit(" by "), stage, F.lit(" with score "), number)
