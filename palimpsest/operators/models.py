"""Lexical detectors: TF-IDF of words and character n-grams with logistic regression, log-odds of words
learned for many groups at once, and built-in expressions. And the registry that scores with several."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import lexical
from palimpsest.operators.cascade import Scorer, classifier_input, columnwise
from palimpsest.operators.lineage import cut, discard, keep
from palimpsest.operators.skew import join_on_unique


def _terms() -> Pipeline:
    """Words of two letters or more and pairs of them; characters 3-5 within what blanks part, padded."""
    # a piece shorter than n has no grams of n but, once, itself
    grams = "IF(length(w) >= {n} OR {n} = 3, transform(sequence(1, greatest(length(w) - {n} + 1, 1)), i -> substring(w, i, {n})), array())"
    each = ", ".join(grams.format(n=k) for k in (3, 4, 5))
    chars = f"SELECT *, flatten(transform(filter(split(lower(_input), '\\\\s+'), x -> x != ''), x -> transform(array(concat(' ', x, ' ')), w -> concat({each}))[0])) AS chars FROM __THIS__"
    return Pipeline(stages=[
        RegexTokenizer(inputCol="_input", outputCol="words", pattern="[^\\p{L}\\p{N}_]+", minTokenLength=2),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        SQLTransformer(statement=chars),
    ])


def _inputs(df: DataFrame) -> DataFrame:
    """df with _input: the text, behind its query where there is one; NULL texts are empty."""
    query = F.col("query") if "query" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_input", classifier_input(F.coalesce("text", F.lit("")), query))


def _split(words: RegexTokenizer, df: DataFrame) -> DataFrame:
    """df (_input) with _words, and _low: the text in lower case."""
    return words.copy().setOutputCol("_words").transform(df).withColumn("_low", F.lower("_input"))


def _counter(spark: SparkSession, vocabulary: pa.Array, kind: str) -> CountVectorizerModel:
    """CountVectorizerModel.from_vocabulary, whose way sends each string in a call of its own."""
    held = spark._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(vocabulary.to_pylist()))  # no term has a line's end
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", held)
    return model.setInputCol(kind).setOutputCol(f"tf_{kind}")


def _classifier(spark: SparkSession, weights: np.ndarray, intercept: float) -> LogisticRegressionModel:
    kind = "org.apache.spark.ml.classification.LogisticRegressionModel"
    vector = _py2java(spark.sparkContext, Vectors.dense(weights))
    return LogisticRegressionModel._create_from_java_class(kind, f"LogisticRegression_{uuid.uuid4().hex[:12]}", vector, intercept)


def train_tfidf(train: DataFrame, vocabulary: int = 200_000, c: float = 4.0, iterations: int = 50) -> PipelineModel:
    """Fitted on rows (text, label[, query]): the most frequent terms of each kind that two texts have, with
    idf = ln((1 + n) / (1 + df)) + 1, each kind of unit length; regularised by 1 / (c n). Labels are 0 and 1.
    Raises if the losses aren't numbers or never fall."""
    spark, terms = train.sparkSession, _terms()
    own = _inputs(train.where("text is not null and label is not null")).groupBy("_input", F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("weight"))
    own = keep(own, drop_shuffles=True)
    if other := own.where("label not in (0, 1)").select("label").first():
        raise ValueError(f"a label of {other[0]}")
    split = _split(terms.getStages()[0], own).select(F.col("_words").alias("words"), F.col("_low").alias("low"), "label", "weight")
    known, weights, intercept, losses = lexical.fit(split, vocabulary, c, iterations)
    discard(own)
    check_losses(losses)
    stages = []
    for kind, (names, idf) in zip(lexical.KINDS, known):
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=f"tf_{kind}", outputCol=f"w_{kind}")
        stages += [_counter(spark, names, kind), scale, Normalizer(inputCol=f"w_{kind}", outputCol=f"u_{kind}")]
    stages.append(VectorAssembler(inputCols=["u_terms", "u_chars"], outputCol="features"))
    return PipelineModel(stages=[*terms.getStages(), *stages, _classifier(spark, weights, intercept)])


def check_losses(losses: list[float], tolerance: float = 1e-2) -> None:
    """Raises if training diverged, or if the loss of several steps never left ln 2, so that one class is
    always answered."""
    if any(not math.isfinite(x) for x in losses):
        raise ArithmeticError("training diverged")
    if len(losses) > 2 and abs(min(losses) - math.log(2)) < tolerance and losses[0] - min(losses) < tolerance:
        raise ArithmeticError("training left the loss at ln 2")


def tfidf_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with detector_score, the probability of an injection as the model's stages have it; NULL text is
    scored as ''."""
    of = lambda kind: [s for s in model.stages if isinstance(s, kind)]
    known = [(pa.array(c.vocabulary, pa.string()), s.getScalingVec().toArray()) for c, s in zip(of(CountVectorizerModel), of(ElementwiseProduct))]
    (classifier,) = of(LogisticRegressionModel)
    score = lexical.probability(df.sparkSession, known, classifier.coefficients.toArray(), classifier.intercept)
    return _split(of(RegexTokenizer)[0], _inputs(df)).select(*df.columns, score("_words", "_low").alias("detector_score"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def words(text: Column) -> Column:
    """Distinct words of two letters or digits and more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def word_odds(train: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(word, odds): what a word says for each group of rows (group, text, label), as a map of the groups'
    log-odds; all groups are learned in one pass. Words that fewer than ``least`` rows have are left out;
    so are groups of one class."""
    rows = train.where("text is not null and label in (0, 1)").select(F.col(group).alias("g"), "label", words(F.col("text")).alias("w"))
    count = lambda y: F.count(F.when(F.col("label") == y, 1)).cast("double")
    sizes = rows.groupBy("g").agg(count(1).alias("p"), count(0).alias("q")).where("p > 0 and q > 0 and g is not null")
    counts = rows.select("g", "label", F.explode("w").alias("word")).groupBy("g", "word").agg(count(1).alias("a"), count(0).alias("b")).where(F.col("a") + F.col("b") >= least)
    odds = F.log((F.col("a") + 0.5) / (F.col("p") + 1)) - F.log((F.col("b") + 0.5) / (F.col("q") + 1))
    return counts.join(sizes, "g").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("g", odds))).alias("odds"))  # one entry a group


def odds_scores(weights: DataFrame, df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """(key, keep, trained_on, score): rows (key, text) scored by each group's words (word_odds). Every row
    has a score by every group; words that a group doesn't know weigh nothing."""
    groups = weights.select(F.explode("odds").alias("trained_on", "x")).select("trained_on").distinct()
    rows = df.where(F.col("text").isNotNull())
    each = rows.select(key, F.explode(words(F.col("text"))).alias("word"))
    held = cut(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(weights, "word"))
    sums = join_on_unique(each, held, ["word"], "n").select(key, F.explode("odds").alias("trained_on", "x")).groupBy(key, "trained_on").agg(F.round(F.sum("x"), 9).alias("score"))
    every = rows.select(key, *keep).join(F.broadcast(groups))  # a row for each of the few groups
    return every.join(sums, [key, "trained_on"], "left").select(key, *keep, "trained_on", F.coalesce("score", F.lit(0.0)).alias("score"))


def lexical_classifier(weights: dict[str, float]) -> Scorer:
    """1 - exp(-sum of the weights of words present)."""

    def score(text: Column) -> Column:
        total = sum((F.when(F.lower(text).contains(w), F.lit(x)).otherwise(0.0) for w, x in weights.items()), F.lit(0.0))
        return F.when(text.isNotNull(), 1 - F.exp(-total))

    return columnwise(score)


def rule_detector() -> Scorer:
    return columnwise(lambda text: F.when(text.isNotNull(), rules.rule_score(text)))


def score_frame(df: DataFrame, detectors: dict[str, Scorer], use_query: bool = True) -> DataFrame:
    """df with detector and score, a row for each detector of a registry; texts stand behind their query
    where df has one and it is asked for. NULL texts have NULL scores."""
    query = F.col("query") if use_query and "query" in df.columns else F.lit(None).cast("string")
    scored = df.withColumns({f"_score_{i}": d.one(classifier_input(F.col("text"), query)) for i, d in enumerate(detectors.values())})
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"_score_{i}").alias("score")) for i, n in enumerate(detectors)])
    return scored.select(*df.columns, F.explode(each).alias("_x")).select(*df.columns, "_x.*")
