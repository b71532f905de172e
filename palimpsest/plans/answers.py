"""Queries of retrieval with a defence between the passages and the prompt, and of the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.operators import cascade, generate, retrieval
from palimpsest.operators.ranks import row_index
from palimpsest.operators.tables import table
from palimpsest.plans import datasets, sql
from palimpsest.plans.inspection import classifier, judge
from palimpsest.registry import query, quoted, scratch
from palimpsest.sources import readers

_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
# the tables don't say which text a vector stands for; the k-th vector takes the k-th document of the hash order
_CORPUS = "(SELECT vec_id, embedding, text FROM embeddings JOIN (SELECT row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS vec_id, text FROM (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)) USING (vec_id))"
_SEEN = f"""(SELECT query_id, rank, vec_id FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 9) DESC, c.vec_id) AS rank
  FROM embeddings q, {_CORPUS} c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= {fixed.TOP_K})"""
_PROMPT = "'Answer from the passages only.' || chr(10) || chr(10) || 'Passages:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question"


def _corpus(spark, folder):
    texts = row_index(table(spark, folder, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id", "vec_id").select("vec_id", "text")
    return table(spark, folder, "embeddings").select("vec_id", "embedding").join(texts, "vec_id")


def _queries(spark, folder):
    q = table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return q.withColumn("question", F.concat(F.lit("What is said in passage "), F.col("query_id").cast("string"), F.lit("?")))


@query(f"""WITH seen_ AS (SELECT * FROM {_SEEN}), {sql.inspected("SELECT DISTINCT vec_id, text FROM seen_ JOIN " + _CORPUS + " USING (vec_id)", "vec_id")},
  kept_ AS (SELECT query_id, string_agg(clean_text, {quoted(fixed.CONTEXT_SEPARATOR)} ORDER BY rank) FILTER (action <> 'block' AND regexp_matches(clean_text, '[^\\s]')) AS context,
    list(vec_id ORDER BY rank) AS retrieved, list(action ORDER BY rank) AS actions FROM seen_ JOIN verdicts_ USING (vec_id) GROUP BY query_id)
  SELECT query_id, md5({_PROMPT}) AS answer, array_to_string(retrieved, ',') AS retrieved, array_to_string(actions, ',') AS actions, length(context) AS n FROM (
    SELECT query_id, 'What is said in passage ' || query_id || '?' AS question, coalesce(context, {quoted(fixed.NO_CONTEXT)}) AS context, retrieved, actions FROM kept_)""")
def answers(spark, folder):
    """Top-k passages of every query, defended by the rules, joined to a prompt and answered; the answer
    stands in for a model's and is the prompt's hash."""
    out = retrieval.answer(_queries(spark, folder), _corpus(spark, folder), lambda p: cascade.defend(p, "s1", classifier(), judge, canonical=True), F.md5)
    ids = F.transform("retrieved", lambda x: x.cast("string"))
    return out.where("retrieved is not null").select("query_id", "answer", F.array_join(ids, ",").alias("retrieved"), F.array_join("actions", ",").alias("actions"), F.length("context").cast("bigint").alias("n"))


@query()
def answers_full(spark, folder):
    """The same with every stage of the defence, from S0 on, and each query's successor pinned."""
    pins = _queries(spark, folder).select("query_id", (F.col("query_id") + 1).alias("pin_id"))
    out = retrieval.answer(_queries(spark, folder), _corpus(spark, folder), lambda p: cascade.defend(p, "full", classifier(), judge), F.md5, pinned=pins)
    return out.select("query_id", "answer", F.array_join("actions", ",").alias("actions"), "escalated")


_MOVED = "CASE WHEN vec_id = 1 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) ELSE CAST(embedding AS DOUBLE[]) END"
_OVER = f"(SELECT vec_id, {_MOVED} AS embedding FROM embeddings)"


@query(f"SELECT q.vec_id AS query_id, count(*) AS rank FROM embeddings q JOIN {_OVER} p ON p.vec_id = q.vec_id + 1, {_OVER} c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND round({_DOT}, 9) >= round({_DOT.replace('c.emb', 'p.emb')}, 9) GROUP BY q.vec_id")
def replaced_rank(spark, folder):
    """Ranks of the rows after the queries, once the row after query 0 has been replaced."""
    e = retrieval.replace_row(table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), 1, F.transform("embedding", lambda x: -x))
    q = table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    t = q.join(e.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("pe")), "query_id").select("query_id", "qe", retrieval.dot(F.col("qe"), F.col("pe")).alias("own"))
    return retrieval.count_nearer(t, e)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS was, 1.0::DOUBLE AS size FROM embeddings")
def unit_vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    size = lambda v: F.sqrt(retrieval.dot(v, v))
    return e.select("vec_id", F.round(size(F.col("embedding")), 6).alias("was"), F.round(size(retrieval.normalized(F.col("embedding"))), 6).alias("size"))


_LANGS = ("en", "es", "it")


@query(f"""SELECT doc_id, domain, md5(text) AS form, question FROM (SELECT lang || '-test-' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS doc_id, lang AS domain, text,
    substr(coalesce(nullif(source, ''), 'Answer the question.'), 1, {fixed.QUERY_MAX}) AS question, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE lang IN ('en', 'es', 'it'))
  WHERE r <= {fixed.MAX_DOCS_PER_DOMAIN} AND length(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) >= {fixed.LEAST_CHARS}""")
def source_documents(spark, folder):
    """Documents of several raw tables, the first 150 of each, as the dataset build reads them."""
    d = table(spark, folder, "documents")
    raw = {x: d.where(F.col("lang") == x).select("doc_id", F.col("text").alias("context"), F.col("source").alias("question")) for x in _LANGS}
    return readers.read_documents(raw, "test", "doc_id").select("doc_id", "domain", F.md5("text").alias("form"), "question")


@query("SELECT CAST(id AS VARCHAR) AS id, md5(context) AS form, question FROM (SELECT doc_id AS id, text AS context, 'Summarise it.' AS question FROM documents ORDER BY doc_id LIMIT 2000)")
def article_source(spark, folder):
    rows = readers.read_articles(spark, f"{folder}/documents.parquet", "doc_id", "Summarise it.", "text")
    return rows.select("id", F.md5("context").alias("form"), "question")


@query("SELECT category, md5(text) AS form, count(*) AS n FROM (SELECT category, attack_id, min(text) AS text FROM attacks WHERE category IS NOT NULL AND text IS NOT NULL AND split = 'train' AND kind = 'text' GROUP BY category, attack_id) GROUP BY 1, 2")
def attack_json_source(spark, folder):
    """Attacks written as a JSON object of lists by category and read again; a fixture of bounded size."""
    at = scratch(spark, "attacks")
    rows = table(spark, folder, "attacks").where("category is not null and text is not null and split = 'train' and kind = 'text'").groupBy("category", "attack_id").agg(F.min("text").alias("text"))
    by = rows.groupBy("category").agg(F.collect_list("text").alias("texts")).agg(F.map_from_entries(F.collect_list(F.struct("category", "texts"))).alias("m"))
    by.select(F.to_json("m").alias("value")).write.text(at)
    back = readers.read_attacks(spark, at, "text", "train")
    return back.groupBy("category", F.md5("text").alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(text) AS form, label FROM hard_cases WHERE text IS NOT NULL")
def labelled_json_source(spark, folder):
    at = scratch(spark, "labelled")
    readers.write_json(table(spark, folder, "hard_cases").where("text is not null").select(F.col("text").alias("prompt"), "label"), at)
    return readers.read_labelled_array(spark, at).select(F.md5("text").alias("form"), "label")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS form FROM documents WHERE text IS NOT NULL")
def json_document_source(spark, folder):
    """Documents written as JSON lines, their text as a list of lines, and read as raw documents."""
    at = scratch(spark, "lines")
    rows = table(spark, folder, "documents").where("text is not null")
    rows.select(F.split("text", "\n").alias("context"), F.col("doc_id").cast("string").alias("question")).write.json(at)
    back = readers.read_json_documents(spark, at)
    return back.select(F.col("question").alias("id"), F.md5("context").alias("form"))


@query(f"SELECT id, length(text) AS n FROM {datasets._reviews_sql()} WHERE length(text) <= {fixed.WINDOW_CHARS}")
def clean_corpus(spark, folder):
    """A corpus of reviews and poisoned copies, written as JSON lines and read again: what a retriever is
    built on are its clean documents, in passages."""
    clean = generate.reviews(spark, datasets.N_REVIEWS)
    both = clean.unionByName(generate.poison_some(clean, datasets.N_POISONED), allowMissingColumns=True)
    meta = F.create_map(F.lit("poisoned"), F.col("poisoned").cast("string"), F.lit("house"), F.col("house"))
    back = readers.write_corpus(both.select("id", "text", meta.alias("meta")), scratch(spark, "corpus"))
    return generate.char_windows(readers.clean_only(back), "id").select("id", F.length("text").cast("bigint").alias("n"))


@query("SELECT CAST(chunk_id AS VARCHAR) AS id, CAST(label AS DOUBLE) AS x FROM chunks UNION ALL SELECT verdict_id, score FROM verdicts")
def union_relaxed(spark, folder):
    """Rows of two tables whose columns differ in type."""
    a = table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), F.col("label").alias("x"))
    return readers.union_relaxed(a, table(spark, folder, "verdicts").select(F.col("verdict_id").alias("id"), F.col("score").alias("x")))
