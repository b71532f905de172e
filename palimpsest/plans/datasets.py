"""Queries of the dataset build: grammar, variants, labelled chunks, splits, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import draws, fixed
from palimpsest.operators import generate
from palimpsest.operators.tables import table
from palimpsest.plans import sql
from palimpsest.registry import query, quoted

_DOCS = "(SELECT doc_id, min(domain) AS domain, min(text) AS text, min(question) AS question FROM clean_docs WHERE {where} GROUP BY doc_id)"
_ATTACKS = "(SELECT attack_id, min(category) AS category, min(text) AS text FROM attacks WHERE split = '{split}' GROUP BY attack_id)"


def docs(spark, folder, where: str = "true") -> DataFrame:
    """Clean documents, one row each."""
    return table(spark, folder, "clean_docs").where(where).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("domain", "text", "question")])


def attacks(spark, folder, split: str) -> DataFrame:
    return table(spark, folder, "attacks").where(F.col("split") == split).groupBy("attack_id").agg(F.min("category").alias("category"), F.min("text").alias("text"))


_VALUES = lambda xs: "(VALUES " + ", ".join(f"({quoted(x)})" for x in xs) + ") t(x)"


@query(f"SELECT CAST({len(generate.STYLES)} AS BIGINT) AS train, CAST({len(generate.HELD_STYLES)} AS BIGINT) AS held, count(*) AS shared FROM (SELECT x FROM {_VALUES(generate.STYLES)} INTERSECT SELECT x FROM {_VALUES(generate.HELD_STYLES)})")
def style_disjoint(spark, folder):
    a, b = (spark.createDataFrame([(s,) for s in x], "x string") for x in (generate.STYLES, generate.HELD_STYLES))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(a.count()).cast("bigint").alias("train"), F.lit(b.count()).cast("bigint").alias("held"), "shared")


@query(f"SELECT DISTINCT doc_id, {sql.synthetic_attack('doc_id', generate.STYLES)} AS attack, {sql.synthetic_attack('doc_id', generate.HELD_STYLES)} AS held FROM clean_docs")
def synthetic_attacks(spark, folder):
    key = F.col("doc_id")
    return table(spark, folder, "clean_docs").select("doc_id", generate.synthetic_attack(key).alias("attack"), generate.synthetic_attack(key, generate.HELD_STYLES).alias("held")).distinct()


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p LIKE 'CNRY%' THEN 'code' WHEN p LIKE 'http%' THEN 'link' ELSE 'name' END AS kind FROM (SELECT DISTINCT doc_id, {sql.payload('doc_id')} AS p FROM clean_docs)) GROUP BY kind")
def payload_kinds(spark, folder):
    p = generate.payload(F.col("doc_id"))
    rows = table(spark, folder, "clean_docs").select("doc_id", p.alias("p")).distinct()
    return rows.groupBy(F.when(F.col("p").startswith("CNRY"), "code").when(F.col("p").startswith("http"), "link").otherwise("name").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_CHUNK_OUT = "chunk_id, doc_id, position_index, md5(text) AS form, query, label, domain, attack_id, attack_category, injection_position"


def _chunk_out(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "doc_id", "position_index", F.md5("text").alias("form"), "query", "label", "domain", "attack_id", "attack_category", "injection_position")


_TRAIN, _TEST = _DOCS.format(where="split = 'train'"), _DOCS.format(where="split = 'test'")


@query(f"SELECT {_CHUNK_OUT} FROM {sql.chunk_records(_TRAIN, _ATTACKS.format(split='train'), fixed.VARIANTS)}")
def chunk_records(spark, folder):
    """Eight variants of each training document, half of them with a drawn attack, in labelled chunks."""
    return _chunk_out(generate.chunk_records(docs(spark, folder, "split = 'train'"), attacks(spark, folder, "train")))


@query(f"SELECT {_CHUNK_OUT} FROM {sql.chunk_records(_TEST, sql.synthetic_attacks(generate.HELD_STYLES), fixed.HELD_VARIANTS)}")
def stealth_records(spark, folder):
    """Test documents with attacks of the grammar in styles that training never sees."""
    return _chunk_out(generate.synthetic_records(docs(spark, folder, "split = 'test'"), generate.HELD_STYLES, fixed.HELD_VARIANTS))


#: Benign prompts that the calibration split needs in these tables; fixed.CALIBRATION_MIN by default.
LEAST = 100
_PROMPTS = f"(SELECT chunk_id AS id, min(text) AS text, max(label) AS label, CASE WHEN {draws.draw_sql('chunk_id', 'prompt', '10')} < 4 THEN 'train' WHEN {draws.draw_sql('chunk_id', 'prompt', '10')} < 6 THEN 'validation' ELSE 'test' END AS split FROM chunks WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY chunk_id)"


def prompts(spark, folder) -> DataFrame:
    """Labelled texts (id, split, text, label) from the chunks, their split drawn from the id."""
    rows = table(spark, folder, "chunks").where("text is not null and label is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    d = draws.draw(F.col("id"), "prompt", 10)
    return rows.withColumn("split", F.when(d < 4, "train").when(d < 6, "validation").otherwise("test"))


def _fraction(rows: str, first: bool) -> str:
    placed = f"(SELECT *, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS all_ FROM {rows})"
    return f"(SELECT doc_id, domain, text, question FROM {placed} WHERE k {'<' if first else '>='} floor(all_ * {fixed.TRAIN_SHARE}::DOUBLE))"


def _splits_sql() -> str:
    fit, held, train, test = _fraction(_TRAIN, True), _fraction(_TRAIN, False), _ATTACKS.format(split="train"), _ATTACKS.format(split="test")
    own = "SELECT '{n}' AS split, 'prompts' AS domain, text, label FROM " + _PROMPTS + " WHERE {w}"
    chunk = lambda n, rows: f"SELECT '{n}' AS split, domain, text, label FROM {rows}"
    benign = f"(SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS k, count(*) OVER () AS have FROM {_PROMPTS} WHERE split = 'test' AND label = 0)"
    parts = [
        chunk("train", sql.chunk_records(fit, train, fixed.VARIANTS)), chunk("train", sql.chunk_records(fit, sql.synthetic_attacks(generate.STYLES), fixed.SYNTHETIC_VARIANTS)), own.format(n="train", w="split = 'train'"),
        chunk("validation", sql.chunk_records(held, train, fixed.VARIANTS)), chunk("validation", sql.chunk_records(held, sql.synthetic_attacks(generate.STYLES), fixed.HELD_VARIANTS)), own.format(n="validation", w="split = 'validation'"),
        f"SELECT 'calibration' AS split, 'prompts' AS domain, text, label FROM {benign} WHERE k < greatest({LEAST}, least(have, {2 * LEAST}))",
        chunk("test", sql.chunk_records(_TEST, test, fixed.VARIANTS)), chunk("stealth", sql.chunk_records(_TEST, sql.synthetic_attacks(generate.HELD_STYLES), fixed.HELD_VARIANTS)),
        chunk("all_train", sql.chunk_records(fit, train, fixed.VARIANTS)), chunk("all_train", sql.chunk_records(held, train, fixed.VARIANTS)),
    ]
    return f"SELECT split, domain, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({' UNION ALL '.join(parts)}) GROUP BY split, domain"


@query(_splits_sql())
def dataset_splits(spark, folder):
    """What the six splits of the whole build hold, by domain."""
    made = generate.dataset_splits(docs(spark, folder, "split = 'train'"), docs(spark, folder, "split = 'test'"), attacks(spark, folder, "train"), attacks(spark, folder, "test"), prompts(spark, folder), LEAST)
    out = None
    for name, rows in made.items():
        own = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.sum(F.length("text")).alias("chars")).select(F.lit(name).alias("split"), "domain", "n", "positives", "chars")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"SELECT domain, count(*) AS n FROM {_fraction(_DOCS.format(where='true'), True)} GROUP BY domain")
def doc_split_85(spark, folder):
    """Documents by domain in the first 85 % of a shuffled order."""
    return generate.fraction_split(docs(spark, folder), "doc_id")[0].groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CAST(i AS INT) AS position_index, md5(substr(text, 750 * i + 1, 900)) AS form, '' AS query, 0 AS label FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 900 THEN 1 ELSE (length(text) + 749) // 750 END)) AS i FROM clean_docs WHERE text IS NOT NULL)
  WHERE length(text) <= 900 OR regexp_matches(substr(text, 750 * i + 1, 900), '[^ \\t\\n\\x0b\\f\\r]')""")
def corpus_calibration(spark, folder):
    """Benign passages of the corpus in use, to calibrate on."""
    rows = generate.char_windows(table(spark, folder, "clean_docs"), "doc_id")
    return rows.select("doc_id", "position_index", F.md5("text").alias("form"), F.lit("").alias("query"), F.lit(0).alias("label"))


N_REVIEWS, N_POISONED = 300, 60


def _reviews_sql() -> str:
    d = lambda tag, n: draws.draw_sql("i", tag, str(n))
    themes = " UNION ALL ".join(f"SELECT i, '{t}' AS t, {d('theme' + t, 1_000_000)} AS d FROM range(0, {N_REVIEWS}) r(i)" for t in generate._REVIEW_THEMES)
    glad = f"{d('mood', 100)} < 65"
    sentence = f"CASE WHEN {glad} THEN {sql.pick(generate._GOOD, 'i', 'words')} ELSE {sql.pick(generate._POOR, 'i', 'words')} END"
    return f"""(SELECT 'review-' || lpad(CAST(i AS VARCHAR), 6, '0') AS id, 'Nights at ' || house || ': ' || CAST(1 + {d('nights', 6)} AS VARCHAR) || '. ' || said || ' ' || CASE WHEN {glad} THEN 'Recommended.' ELSE 'Not again.' END AS text,
      house, CASE WHEN {glad} THEN 'positive' ELSE 'negative' END AS sentiment, themes FROM (
      SELECT i, [{', '.join(quoted(h) for h in generate.HOUSES)}][CAST(i % {len(generate.HOUSES)} + 1 AS INT)] AS house, string_agg(replace({sentence}, '{{t}}', t), ' ' ORDER BY d, t) AS said, string_agg(t, ',' ORDER BY t) AS themes
      FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, t) AS r FROM ({themes})) WHERE r <= 2 + {d('themes', 2)} GROUP BY i))"""


@query(f"SELECT * FROM {_reviews_sql()}")
def reviews(spark, folder):
    return generate.reviews(spark, N_REVIEWS).drop("poisoned")


def _poisoned_reviews_sql() -> str:
    attack = f"replace({sql.pick(generate.CARRIERS['baseline'], 'id', 'vector')}, '{{m}}', {sql.marker('id')})"
    drawn = f"(SELECT *, ['start', 'middle', 'end'][CAST(k % 3 + 1 AS INT)] AS place, {attack} AS attack, {sql.marker('id')} AS canary FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS k FROM {_reviews_sql()}) WHERE k < {N_POISONED})"
    return f"SELECT id || '-poisoned' AS id, md5(head || attack || tail) AS form, house, canary, place AS injection_position, CAST(length(head) AS INT) AS span_start, CAST(length(head) + length(attack) AS INT) AS span_end, 1 AS poisoned FROM {sql.poisoned(drawn, 'id')}"


@query(_poisoned_reviews_sql())
def poisoned_reviews(spark, folder):
    rows = generate.poison_some(generate.reviews(spark, N_REVIEWS), N_POISONED)
    return rows.select("id", F.md5("text").alias("form"), "house", "canary", "injection_position", "span_start", "span_end", "poisoned")
