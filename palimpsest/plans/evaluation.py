"""Queries of the evaluation: detectors side by side, thresholds, transfer between domains, hard cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import draws, fixed
from palimpsest.operators import cascade, generate, metrics, models, ranks, reports
from palimpsest.operators.lineage import cut
from palimpsest.operators.tables import table
from palimpsest.plans import datasets, inspection, sql
from palimpsest.plans.inspection import WEIGHTS
from palimpsest.registry import query, quoted, scratch
from palimpsest.sources import readers

FPRS = fixed.TARGET_FPRS


def auc_sql(rows: str, keys: str) -> str:
    """(keys, n, auc) of rows (keys, label, score)."""
    return f"""(SELECT {keys}, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos * (below + neg / 2.0::DOUBLE)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
      SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM (
        SELECT {keys}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {rows} GROUP BY {keys}, score)) GROUP BY {keys})"""


def tau_sql(rows: str, keys: str, fpr: float) -> str:
    return f"(SELECT {keys}, score AS tau FROM (SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows} WHERE label = 0) WHERE r = least(floor(n * {fpr}::DOUBLE), n - 1) + 1)"


def rates_sql(rows: str, keys: str, taus: str) -> str:
    share = lambda y: f"avg(CASE WHEN label = {y} THEN CAST(score > tau AS INT) END)"
    return f"(SELECT {keys}, tau, {share(1)} AS tpr, {share(0)} AS fpr FROM {rows} JOIN {taus} USING ({keys}) GROUP BY {keys}, tau)"


def f1_sql(rows: str, keys: str, at: float = 0.5) -> str:
    return f"(SELECT {keys}, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT {keys}, count(*) FILTER (score > {at} AND label = 1) AS tp, count(*) FILTER (score > {at} AND label = 0) AS fp, count(*) FILTER (score <= {at} AND label = 1) AS fn FROM {rows} GROUP BY {keys}))"


def named(fpr: float) -> str:
    return f"{fpr:g}".replace(".", "_")


def table_sql(rows: str, keys: str, calibration: str | None = None) -> str:
    out, joins = [f"m.{k.strip()}" for k in keys.split(",")] + ["n", "round(auc, 9) AS auc", "round(f1, 9) AS f1"], f"{auc_sql(rows, keys)} m LEFT JOIN {f1_sql(rows, keys)} USING ({keys})"
    for i, f in enumerate(FPRS):
        joins += f" LEFT JOIN {rates_sql(rows, keys, tau_sql(rows, keys, f))} o{i} USING ({keys})"
        out.append(f"round(o{i}.tpr, 9) AS tpr_at_fpr_{named(f)}")
        if calibration:
            joins += f" LEFT JOIN {rates_sql(rows, keys, tau_sql(calibration, keys, f))} c{i} USING ({keys})"
            out += [f"round(c{i}.tau, 9) AS tau_{named(f)}", f"round(c{i}.tpr, 9) AS tpr_ext_tau_{named(f)}", f"round(c{i}.fpr, 9) AS fpr_ext_tau_{named(f)}"]
    return f"SELECT {', '.join(out)} FROM {joins}"


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", *[F.round(c, 9).alias(c) for c in df.columns if c not in (*keys, "n")])


def detectors() -> dict:
    """The registry: what stands for each name here; a trained model is one more entry."""
    return {"rules_s1": models.rule_detector(), "lexical": models.lexical_classifier(WEIGHTS)}


# texts stand behind their query, as the detectors read them
_BOTH = f"CASE WHEN coalesce(query, '') <> '' THEN query || {quoted(fixed.PAIR_SEPARATOR)} || raw ELSE raw END"


def _long(rows: str, columns: str) -> str:
    read = f"(SELECT {columns}, {_BOTH} AS text FROM {rows})"
    return f"(SELECT {columns}, 'rules_s1' AS detector, {sql.SCORE} AS score FROM {read} UNION ALL SELECT {columns}, 'lexical', {sql.lexical(WEIGHTS)} FROM {read})"


_HARD = _long("(SELECT case_id, label, query, text AS raw FROM hard_cases WHERE label IS NOT NULL AND text IS NOT NULL)", "label")
_CALIB = _long("(SELECT 0 AS label, NULL AS query, text AS raw FROM (SELECT doc_id, min(text) AS text FROM clean_docs WHERE text IS NOT NULL GROUP BY doc_id))", "label")


def calibration(spark, folder) -> DataFrame:
    """Scores of every detector on the clean documents, all benign."""
    rows = table(spark, folder, "clean_docs").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(0).alias("label"))
    return models.score_frame(rows, detectors()).drop("text")


def hard_scores(spark, folder) -> DataFrame:
    rows = table(spark, folder, "hard_cases").where("label is not null and text is not null").select("text", "query", "label")
    return models.score_frame(rows, detectors()).drop("text", "query")


@query(table_sql(_HARD, "detector", _CALIB))
def detector_comparison(spark, folder):
    """Every detector of the registry on the held-out passages, with thresholds from the clean documents."""
    return rounded(metrics.detector_table(hard_scores(spark, folder), ["detector"], calibration=calibration(spark, folder)), ["detector"])


@query()
def detector_intervals(spark, folder):
    """Intervals of the AUC and of the recalls over 1,000 resamples."""
    return metrics.detector_intervals(hard_scores(spark, folder), ["detector"])


@query(f"SELECT detector, a.tau AS tau_lo, b.tau AS tau_hi FROM {tau_sql(_CALIB, 'detector', max(FPRS))} a JOIN {tau_sql(_CALIB, 'detector', min(FPRS))} b USING (detector)")
def calibrated_thresholds(spark, folder):
    return metrics.calibrated(calibration(spark, folder), ["detector"])


_S = "(SELECT v.verdict_id, c.domain, c.label, v.score FROM (SELECT verdict_id, min(chunk_id) AS chunk_id, min(score) AS score FROM verdicts GROUP BY verdict_id) v JOIN (SELECT chunk_id, max(domain) AS domain, max(label) AS label FROM chunks GROUP BY chunk_id) c USING (chunk_id) WHERE label IS NOT NULL AND score IS NOT NULL)"


def scores(spark, folder) -> DataFrame:
    """(verdict_id, domain, label, score): each verdict's score with its chunk's label."""
    v = table(spark, folder, "verdicts").groupBy("verdict_id").agg(F.min("chunk_id").alias("chunk_id"), F.min("score").alias("score"))
    c = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.max("domain").alias("domain"), F.max("label").alias("label"))
    return v.join(c, "chunk_id").where("label is not null and score is not null").select("verdict_id", "domain", "label", "score")


@query(f"""WITH t AS (SELECT tau FROM {tau_sql(f"(SELECT 1 AS one, * FROM {_S})", "one", max(FPRS))}) SELECT CASE WHEN grouping(domain) = 1 THEN 'all' ELSE coalesce(domain, '(none)') END AS domain, count(*) AS n,
  round(avg(CAST(score > (SELECT tau FROM t) AS INT)), 9) AS fpr FROM {_S} WHERE label = 0 GROUP BY ROLLUP (domain)""")
def reality_check(spark, folder):
    """False positive rates, per domain and over all, of the threshold that all benign scores set."""
    s = scores(spark, folder).where("label = 0")
    tau = metrics.threshold_at_fpr(s, [], max(FPRS))
    rows = s.groupBy("domain", "score").count().join(F.broadcast(tau), how="cross")  # one row
    over = F.sum(F.when(F.col("score") > F.col("tau"), F.col("count")).otherwise(0))
    out = rows.rollup("domain").agg(F.sum("count").alias("n"), F.round(over / F.sum("count"), 9).alias("fpr"), F.grouping("domain").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("domain", F.lit("(none)"))).alias("domain"), "n", "fpr")


_CHUNKS = "(SELECT chunk_id, max(domain) AS domain, max(label) AS label, min(text) AS text FROM chunks WHERE text IS NOT NULL AND domain IS NOT NULL AND label IS NOT NULL GROUP BY chunk_id)"
_FIT = f"{draws.draw_sql('chunk_id', 'split', '100')} < 85"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1))"


def _transfer_sql() -> str:
    train = f"(SELECT domain AS g, label, {_WORDS} AS w FROM {_CHUNKS} WHERE {_FIT} UNION ALL SELECT 'all', label, {_WORDS} FROM {_CHUNKS} WHERE {_FIT})"
    return f"""WITH train_ AS (SELECT * FROM {train}), sizes_ AS (SELECT g, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS q FROM train_ GROUP BY g HAVING p > 0 AND q > 0),
      odds_ AS (SELECT g, word, ln((a + 0.5::DOUBLE) / (p + 1)) - ln((b + 0.5::DOUBLE) / (q + 1)) AS x FROM (SELECT g, word, count(*) FILTER (label = 1)::DOUBLE AS a, count(*) FILTER (label = 0)::DOUBLE AS b FROM (SELECT g, label, unnest(w) AS word FROM train_) GROUP BY g, word HAVING a + b >= 2) JOIN sizes_ USING (g)),
      test_ AS (SELECT chunk_id, domain, label, {_WORDS} AS w FROM {_CHUNKS} WHERE NOT ({_FIT})),
      sums_ AS (SELECT chunk_id, g, round(sum(x), 9) AS score FROM (SELECT chunk_id, unnest(w) AS word FROM test_) JOIN odds_ USING (word) GROUP BY chunk_id, g),
      scored_ AS (SELECT s.g AS trained_on, domain AS tested_on, label, coalesce(score, 0.0::DOUBLE) AS score FROM test_ t CROSS JOIN (SELECT g FROM sizes_) s LEFT JOIN sums_ USING (chunk_id, g))
      SELECT m.trained_on, m.tested_on, n, round(auc, 6) AS auc, {', '.join(f'round(o{i}.tpr, 9) AS tpr_at_fpr_{named(f)}' for i, f in enumerate(FPRS))} FROM {auc_sql('scored_', 'trained_on, tested_on')} m
      {' '.join(f"LEFT JOIN {rates_sql('scored_', 'trained_on, tested_on', tau_sql('scored_', 'trained_on, tested_on', f))} o{i} USING (trained_on, tested_on)" for i, f in enumerate(FPRS))} WHERE auc IS NOT NULL"""


@query(_transfer_sql())
def transfer_matrix(spark, folder):
    """A detector of words trained on each domain, and one on all, tested on every domain's other chunks."""
    rows = table(spark, folder, "chunks").where("text is not null and domain is not null and label is not null")
    rows = rows.groupBy("chunk_id").agg(F.max("domain").alias("domain"), F.max("label").alias("label"), F.min("text").alias("text"))
    fit = generate.hash_split(F.col("chunk_id"), 85)
    train = rows.where(fit)
    odds = models.word_odds(train.unionByName(train.withColumn("domain", F.lit("all"))), "domain")
    scored = models.odds_scores(odds, rows.where(~fit), "chunk_id", ["domain", "label"]).withColumnRenamed("domain", "tested_on")
    out = metrics.transfer(scored)
    return out.select("trained_on", "tested_on", "n", F.round("auc", 6).alias("auc"), *[F.round(f"tpr_at_fpr_{named(f)}", 9).alias(f"tpr_at_fpr_{named(f)}") for f in FPRS])


@query("SELECT case_id, kind, score, label, domain FROM hard_cases")
def hard_cases_json(spark, folder):
    """Hard cases written as one JSON array and read again."""
    at = scratch(spark, "json")
    readers.write_json(table(spark, folder, "hard_cases").select("case_id", "kind", "score", "label", "domain"), at)
    return readers.read_json(spark, at, "case_id string, kind string, score double, label int, domain string")


#: Attacks of each family in a run.
STEPS = 150


def asr_cases(spark, folder) -> DataFrame:
    """(key, step, family, vector, place, mark, text): the same plan of documents and positions for every
    family of vectors, each with the family's own attack put in."""
    docs = ranks.row_index(datasets.docs(spark, folder, "text is not null"), "doc_id", "k").select("k", "text")
    n = max(1, docs.count())
    step = F.col("id").cast("int")
    rows = spark.range(STEPS).select(step.alias("step"), F.pmod("id", F.lit(n)).alias("k"), F.explode(F.array(*[F.lit(f) for f in generate.CARRIERS])).alias("family"))
    rows = rows.withColumn("key", F.concat_ws("-", "family", "step")).withColumn("place", F.element_at(F.array(*[F.lit(p) for p in fixed.POSITIONS]), F.col("step") % len(fixed.POSITIONS) + 1))
    vector = F.coalesce(*[F.when(F.col("family") == f, draws.draw(F.col("key"), "vector", len(ts)) + 1) for f, ts in generate.CARRIERS.items()])
    rows = rows.withColumn("vector", vector.cast("int")).withColumn("mark", generate.mark_of(F.col("family"), F.col("key")))
    rows = rows.join(F.broadcast(generate.carriers(spark).drop("cid")), ["family", "vector"]).join(docs, "k")
    bad = generate.poison(F.col("text"), F.replace("template", F.lit("{m}"), F.col("mark")), F.col("place"), F.col("key"))
    return rows.select("key", "step", "family", "vector", "place", "mark", bad["text"].alias("text"))


def _asr_cases_sql() -> str:
    flat = "(VALUES " + ", ".join(f"('{f}', {v + 1}, {quoted(t)})" for f, ts in generate.CARRIERS.items() for v, t in enumerate(ts)) + ") AS c(family, vector, template)"
    docs = "(SELECT text, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS many FROM " + datasets._DOCS.format(where="text IS NOT NULL") + ")"
    vector = "CASE family " + " ".join(f"WHEN '{f}' THEN {draws.draw_sql('key', 'vector', str(len(ts)))} + 1" for f, ts in generate.CARRIERS.items()) + " END"
    plan = f"(SELECT step, family, family || '-' || step AS key, ['start', 'middle', 'end'][CAST(step % 3 + 1 AS INT)] AS place FROM range(0, {STEPS}) r(step), (VALUES {', '.join(f'({quoted(f)})' for f in generate.CARRIERS)}) f(family))"
    marked = f"(SELECT *, {vector} AS vector, CASE WHEN family = 'steer' THEN {sql.pick(generate.DECOYS, 'key', 'decoy')} ELSE {sql.marker('key')} END AS mark FROM {plan})"
    met = f"(SELECT m.*, text, replace(template, '{{m}}', mark) AS attack FROM {marked} m JOIN {flat} USING (family, vector) JOIN {docs} d ON d.k = step % d.many)"
    return f"(SELECT key, family, mark, head || attack || tail AS text FROM {sql.poisoned(met, 'key')})"


def _asr_run_sql() -> str:
    w = f"{fixed.Z95}::DOUBLE"
    bound = lambda op: f"((p + {w} * {w} / (2 * n)) {op} {w} * sqrt(p * (1 - p) / n + {w} * {w} / (4 * n * n))) / (1 + {w} * {w} / n)"
    cases, parts = _asr_cases_sql(), [f"SELECT 'none' AS configuration, family, 1 AS success, 0 AS detected, 0 AS escalated FROM {_asr_cases_sql()}"]
    for name, s2, judged in (("s1", None, None), ("s1_s2", sql.lexical(WEIGHTS), None), ("full", sql.lexical(WEIGHTS), inspection._JUDGED)):
        parts.append(f"""(WITH cases_ AS (SELECT * FROM {cases}), {sql.inspected("SELECT key, text FROM cases_", "key", s2, judged)} SELECT '{name}', family, CAST(contains(lower(clean_text), lower(mark)) AS INT), CAST(action <> 'pass' AS INT), escalated FROM verdicts_ JOIN cases_ USING (key))""")
    return f"""SELECT configuration, family, CAST(n AS BIGINT) AS n, round(p, 9) AS asr, round(greatest(0, {bound('-')}), 9) AS asr_ci_low, round(least(1, {bound('+')}), 9) AS asr_ci_high, round(d, 9) AS detection_rate, round(x, 9) AS escalation_rate FROM (
      SELECT configuration, family, count(*)::DOUBLE AS n, avg(success) AS p, avg(detected) AS d, avg(CAST(escalated > 0 AS INT)) AS x FROM ({' UNION ALL '.join(parts)}) GROUP BY configuration, family)"""


@query(_asr_run_sql())
def asr_run(spark, folder):
    """Attack success by configuration and family against a victim that obeys whatever reaches it: an attack
    works if its mark is still in the defended text. The document is always in the context."""
    cases = cut(asr_cases(spark, folder))
    rows = None
    for name in cascade.CONFIGURATIONS:
        own = cascade.defend(cases, name, inspection.classifier(), inspection.judge, **({} if name == "none" else {"canonical": True}))
        hit = F.lower("clean_text").contains(F.lower("mark")).cast("int")
        own = own.select(F.lit(name).alias("configuration"), "family", hit.alias("success"), F.lit(1).alias("poisoned_retrieved"), (F.col("action") != "pass").cast("int").alias("detected"), "escalated", F.lit(None).cast("double").alias("defense_ms"))
        rows = own if rows is None else rows.unionByName(own)
    out = reports.summarise_asr(rows, ["configuration", "family"])
    return out.select("configuration", "family", "n", *[F.round(c, 9).alias(c) for c in ("asr", "asr_ci_low", "asr_ci_high", "detection_rate", "escalation_rate")])
