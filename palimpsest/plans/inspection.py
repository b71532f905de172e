"""Queries of the staged inspection on texts that have been through S0 (verdicts.canonical_text), so that
SQL can say the same from the rules on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, rules, spans
from palimpsest.operators import cascade, models
from palimpsest.operators.tables import table
from palimpsest.plans import sql
from palimpsest.registry import query

WEIGHTS = {"assistant": 1.2, "reply": 0.5, "cnry": 1.5, "override": 0.7, "answer": 0.4, "instruction": 0.9}
_TEXTS = "SELECT DISTINCT verdict_id, canonical_text AS text FROM verdicts WHERE canonical_text IS NOT NULL"
_S2 = sql.lexical(WEIGHTS)
_JUDGED = f"len(list_filter(range(0, greatest(length(text), 1), {fixed.JUDGE_MAX}), lambda i: contains(lower(substr(text, i + 1, {fixed.JUDGE_MAX})), 'cnry'))) > 0"


def judge(text):
    """Stands in for a model: an injection where a window holds the marker's prefix."""
    return cascade.judged_in_windows(lambda w: cascade.judge_reply(F.when(F.lower(w).contains("cnry"), "INJECTION").otherwise("SAFE")), text)


def classifier() -> cascade.Scorer:
    return models.lexical_classifier(WEIGHTS)


def canonical_texts(spark, folder) -> DataFrame:
    return table(spark, folder, "verdicts").where("canonical_text is not null").select("verdict_id", F.col("canonical_text").alias("text")).distinct()


_OUT = "verdict_id, action, round(score, 9) AS score, decided_by, md5(clean_text) AS form, CAST(n_spans AS INT) AS n_spans, fired, escalated"


def _out(df: DataFrame) -> DataFrame:
    return df.select("verdict_id", "action", F.round("score", 9).alias("score"), "decided_by", F.md5("clean_text").alias("form"), F.size("spans").alias("n_spans"), "fired", "escalated")


@query(f"WITH {sql.inspected(_TEXTS, 'verdict_id', _S2, _JUDGED)} SELECT {_OUT} FROM verdicts_")
def inspect_canonical(spark, folder):
    return _out(cascade.inspect(canonical_texts(spark, folder), classifier=classifier(), judge=judge, canonical=True))


@query(f"WITH {sql.inspected(_TEXTS, 'verdict_id', _S2)} SELECT {_OUT} FROM verdicts_")
def inspect_without_judge(spark, folder):
    return _out(cascade.inspect(canonical_texts(spark, folder), classifier=classifier(), canonical=True))


@query(f"WITH {sql.inspected(_TEXTS, 'verdict_id', _S2, _JUDGED)} SELECT verdict_id, CASE WHEN action = 'pass' THEN 'pass' ELSE 'block' END AS action, CASE WHEN action = 'pass' THEN md5(clean_text) ELSE md5('') END AS form FROM verdicts_")
def inspect_block_policy(spark, folder):
    out = cascade.inspect(canonical_texts(spark, folder), classifier=classifier(), judge=judge, canonical=True, policy="block")
    return out.select("verdict_id", "action", F.md5("clean_text").alias("form"))


@query(
    " UNION ALL ".join(
        [f"(SELECT 'none' AS configuration, 'pass' AS action, count(*) AS n FROM ({_TEXTS}) GROUP BY ALL)"]
        + [f"(WITH {sql.inspected(_TEXTS, 'verdict_id', s2, j)} SELECT '{name}' AS configuration, action, count(*) AS n FROM verdicts_ GROUP BY action)" for name, s2, j in (("s1", None, None), ("s1_s2", _S2, None), ("full", _S2, _JUDGED))]
    )
)
def configuration_actions(spark, folder):
    texts = canonical_texts(spark, folder)
    parts = None
    for name in cascade.CONFIGURATIONS:
        own = cascade.defend(texts, name, classifier(), judge, canonical=True) if name != "none" else cascade.defend(texts, name, classifier(), judge)
        counts = own.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("configuration"), "action", "n")
        parts = counts if parts is None else parts.unionByName(counts)
    return parts


@query(f"""WITH {sql.inspected(_TEXTS, 'verdict_id', _S2, _JUDGED)}, steps_ AS (SELECT 'S0' AS stage, 0.0::DOUBLE AS score, '' AS detail FROM decided_ UNION ALL SELECT 'S1', rule, fired FROM decided_
  UNION ALL SELECT 'S2', s2, '' FROM decided_ WHERE rule < {fixed.RULES_DECIDE} UNION ALL SELECT 'S3', CAST(d = 'S3+' AS DOUBLE), CASE WHEN d = 'S3+' THEN 'INJECTION' ELSE 'SAFE' END FROM decided_ WHERE d LIKE 'S3%')
  SELECT stage, detail, count(*) AS n, round(avg(score), 6) AS score FROM steps_ GROUP BY stage, detail""")
def trace_stages(spark, folder):
    out = cascade.inspect(canonical_texts(spark, folder), classifier=classifier(), judge=judge, canonical=True)
    return out.select(F.explode("trace").alias("x")).groupBy("x.stage", "x.detail").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.score"), 6).alias("score"))


@query(f"SELECT chunk_id, s, e FROM {sql.rule_spans('(SELECT chunk_id, text FROM chunks WHERE text IS NOT NULL)', 'chunk_id')}")
def rule_spans(spark, folder):
    rows = table(spark, folder, "chunks").where("text is not null")
    return rows.select("chunk_id", F.explode(rules.all_spans(F.col("text"))).alias("s")).select("chunk_id", F.col("s.start").cast("bigint").alias("s"), F.col("s.end").cast("bigint").alias("e"))


_V = "(SELECT DISTINCT verdict_id, canonical_text AS text, spans FROM verdicts)"
_GIVEN = f"(SELECT verdict_id, x.span_start AS s, x.span_end AS e FROM (SELECT verdict_id, unnest(spans) AS x FROM {_V}))"


def _verdicts(spark, folder):
    v = table(spark, folder, "verdicts").select("verdict_id", "canonical_text", "spans").distinct()
    return v.withColumn("m", spans.merge(F.transform("spans", lambda s: F.struct(s["span_start"].alias("start"), s["span_end"].alias("end"))))).where(F.size("m") > 0)


@query(f"SELECT verdict_id, s, e FROM {sql.expanded(sql.merged(_GIVEN, 'verdict_id'), _V, 'verdict_id')}")
def span_expand(spark, folder):
    grown = F.explode(spans.expand(F.col("canonical_text"), F.col("m"))).alias("s")
    return _verdicts(spark, folder).select("verdict_id", grown).select("verdict_id", F.col("s.start").cast("bigint").alias("s"), F.col("s.end").cast("bigint").alias("e"))


def _escaped(x: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{sign}', '{name}')"
    return x


@query(f"""SELECT verdict_id, md5(string_agg({_escaped('kept')} || '<del>' || {_escaped('gone')} || '</del>', '' ORDER BY s) || {_escaped('max_by(rest, s)')}) AS form FROM (
  SELECT verdict_id, s, substr(text, CAST(coalesce(lag(e) OVER w, 0) + 1 AS BIGINT), CAST(s - coalesce(lag(e) OVER w, 0) AS BIGINT)) AS kept, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS gone,
    substr(text, CAST(e + 1 AS BIGINT)) AS rest FROM {sql.merged(_GIVEN, 'verdict_id')} JOIN {_V} USING (verdict_id) WINDOW w AS (PARTITION BY verdict_id ORDER BY s)) GROUP BY verdict_id""")
def struck_text(spark, folder):
    return _verdicts(spark, folder).select("verdict_id", F.md5(spans.struck(F.col("canonical_text"), F.col("m"))).alias("form"))


@query("""SELECT DISTINCT verdict_id, 'The passage ' || CASE action WHEN 'pass' THEN 'passed' WHEN 'sanitize' THEN 'was cleaned' ELSE 'was blocked' END || ' by ' || decided_by || ' with score ' ||
  CASE WHEN score = 0 THEN '0' WHEN score < 0.001 THEN printf('%.1e', score) ELSE printf('%.3f', round(score, 3)) END AS said FROM verdicts""")
def explain_verdicts(spark, folder):
    return table(spark, folder, "verdicts").select("verdict_id", cascade.explain(F.col("score"), F.col("action"), F.col("decided_by")).alias("said")).distinct()
