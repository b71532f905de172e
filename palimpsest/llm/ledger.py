"""Duplicates hidden by formatting: one record of each, and the number of its copies.

An incremental ledger. It holds, in buckets of the canonical key, how many records have that key,
the earliest of them and the smallest id. A batch is aggregated first (a key held by a third of it
becomes one row per task), then full-outer-joined with the ledger's buckets that it touches, and
only those buckets are written again; a delivery that repeats a known id changes nothing, which is
looked up in the buckets of its ids only. ``load`` takes many batches of one table: the table is read
and keyed once, split by batch, and every batch then reads its own hashes alone.

Two keys: letters and digits of category and text in problem-1 form and lower case; and for field
lists (``name: value`` or ``name=value`` parted by ``;``, ``|`` or line breaks) the sorted letters
and digits of the fields. Records with one of them in common are the same, and so are those that a
chain of such records links: the keys are the two sides of a graph, whose components are the classes.

Cases: a NULL category or text is the same only as NULL; texts without any letter are the same;
rows without id are left out; repeated rows of one id count once, with the content of the earliest
batch and, of one batch, the smallest.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.canon import folded, key128, letters_of
from palimpsest.llm.splits import components
from palimpsest.operators.lineage import cut, ensure_checkpoint_dir
from palimpsest.operators.skew import PER_TASK, join_on_unique
from palimpsest.operators.tables import table

#: Rows of a bucket, by which a ledger's first batch sizes its buckets; and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 4_096
MEMBERS = "id string, seen timestamp_ntz, key struct<h1:bigint,h2:bigint>, alt struct<h1:bigint,h2:bigint>, batch string, ids int"
_FIELD = "^[^\\p{L}\\p{N}]*\\p{L}[\\p{L}\\p{N}_\\- ]{0,40}\\s*[:=]\\s*\\S[\\s\\S]*"


def _present(letters: Column) -> Column:
    return F.when(letters.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), letters))


def list_fields(fold: Column) -> Column:
    """The sorted fields of a folded field list as letters and digits; NULL for other texts."""
    parts = F.filter(F.split(fold, "[;|\\n]"), lambda p: F.trim(p) != "")
    fields = F.when(fold.rlike("[:=]") & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_FIELD)), parts)
    return F.array_sort(F.transform(fields, letters_of))


def keyed(records: DataFrame) -> DataFrame:
    """(id, batch, seen, key, alt) of records (id, category, text, seen[, batch]), one row per id.

    The folded text is made once, before the keys that need it.
    """
    batch = F.coalesce(F.col("batch").cast("string"), F.lit("~")) if "batch" in records.columns else F.lit("~")
    fold = records.where("id is not null").select("id", batch.alias("batch"), "seen", letters_of(folded(F.col("category"))).alias("cat"), folded(F.col("text")).alias("fold"))
    cat = _present(F.col("cat"))
    fields = list_fields(F.col("fold"))
    alt = F.when(fields.isNotNull(), key128(F.concat_ws("\u0001", cat, F.array_join(fields, "\u0002")), "list"))
    key = key128(F.concat(cat, F.lit("\u0001"), _present(letters_of(F.col("fold")))))
    rows = fold.select("id", F.struct("batch", "seen", key.alias("key"), alt.alias("alt")).alias("x"))
    return rows.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.*")


def key_classes(pairs: DataFrame) -> DataFrame:
    """(key, cls, n): the class of each key of pairs (key, alt), alt NULL where there is none, and the
    number of its rows.

    A key whose alts agree takes the alt; only keys of several alts make edges, and what they link is
    brought together by components.
    """
    by_key = cut(pairs.groupBy("key").agg(F.min("alt").alias("a"), F.max("alt").alias("b"), F.count(F.lit(1)).alias("n")))
    several = by_key.where("a != b").select("key", F.col("a").alias("v"))
    edges = cut(pairs.where("alt is not null").join(several, "key").where("alt != v").select(F.col("alt").alias("u"), "v").distinct())
    if edges.isEmpty():
        return by_key.select("key", F.coalesce("a", "key").alias("cls"), "n")
    roots = components(edges).select(F.col("id").alias("a"), "group")
    return by_key.join(roots, "a", "left").select("key", F.coalesce("group", "a", "key").alias("cls"), "n")


class Ledger:
    """Counts by canonical key in a folder that all executors share; batches are added with update(), or
    many at once with load()."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = folder or f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.at: dict[int, str] = {}  # bucket -> the folder that holds its newest version
        self.members: list[str] = []
        self.batches = 0

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def known(self, ids: set[int] | None = None) -> DataFrame:
        """(id, key) of every record that was added, or of those in some buckets of ids."""
        parts = [self.spark.read.schema(MEMBERS).parquet(m) for m in self.members]
        every = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], MEMBERS))
        return (every if ids is None else every.where(F.col("ids").isin(sorted(ids)))).select("id", "key")

    def entries(self, only: set[int] | None = None) -> DataFrame | None:
        """(bucket, key, alt, copies, first, least) of all buckets, or of some."""
        at = [p for b, p in self.at.items() if only is None or b in only]
        return self.spark.read.option("basePath", self.folder).parquet(*at).drop("v") if at else None

    def _accept(self, rows: DataFrame) -> str:
        """Keyed rows whose ids are new, in a folder by batch and bucket of ids."""
        if self.members:
            rows = cut(rows)
            touched = {r[0] for r in rows.select(self._bucket(F.col("id"))).distinct().collect()}  # at most self.buckets rows
            rows = rows.join(self.known(touched).select("id"), "id", "left_anti")
        to = f"{self.folder}/members/{len(self.members)}"
        rows.withColumn("ids", self._bucket(F.col("id"))).write.partitionBy("batch", "ids").parquet(to)
        self.members.append(to)
        return to

    def _add(self, rows: DataFrame, touched: set[int]) -> None:
        """Count new rows (id, seen, key, alt) whose keys are in the buckets ``touched``."""
        self.batches += 1
        added = rows.groupBy("key", "alt").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("seen", "id")).alias("first"), F.min("id").alias("least"))
        added = added.withColumn("bucket", self._bucket(F.col("key")))
        old = self.entries(touched)
        if old is not None:
            a, o = added.alias("a"), old.alias("o")
            both = a.join(o, (F.col("a.bucket") == F.col("o.bucket")) & (F.col("a.key") == F.col("o.key")) & F.col("a.alt").eqNullSafe(F.col("o.alt")), "full_outer")
            added = both.select(
                F.coalesce("a.key", "o.key").alias("key"),
                F.coalesce("a.alt", "o.alt").alias("alt"),
                (F.coalesce("a.copies", F.lit(0)) + F.coalesce("o.copies", F.lit(0))).alias("copies"),
                F.least("a.first", "o.first").alias("first"),
                F.least("a.least", "o.least").alias("least"),
                F.coalesce("a.bucket", "o.bucket").alias("bucket"),
            )
        version = f"{self.folder}/v={self.batches}"
        added.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(version)
        self.at |= {b: f"{version}/bucket={b}" for b in touched}

    def load(self, records: DataFrame) -> None:
        """Add records (id, category, text, seen[, batch]) batch by batch, in the order of their names."""
        if self.buckets is None:
            self.buckets = max(1, min(MOST_BUCKETS, -(-records.count() // BUCKET_ROWS)))
        rows = self.spark.read.schema(MEMBERS).parquet(self._accept(keyed(records)))
        plan: dict[str, set[int]] = {}
        for r in rows.select("batch", self._bucket(F.col("key")).alias("b")).distinct().collect():  # batches times buckets
            plan.setdefault(r["batch"], set()).add(r["b"])
        for batch in sorted(plan):
            self._add(rows.where(F.col("batch") == batch), plan[batch])

    def update(self, batch: DataFrame) -> None:
        """Add one batch of records (id, category, text, seen); ids that are known already are left out."""
        self.load(batch)

    def _by_key(self) -> DataFrame:
        """(key, cls, copies, first, least): one row a key."""
        entries = self.entries()
        cls = key_classes(entries.select("key", "alt")).drop("n")
        sums = entries.groupBy("key").agg(F.sum("copies").alias("copies"), F.min("first").alias("first"), F.min("least").alias("least"))
        return sums.join(cls, "key")

    def classes(self) -> DataFrame:
        """(cls, copies, least, earliest): one row per class, with the copies of all its entries."""
        sums = self._by_key().groupBy("cls").agg(F.sum("copies").alias("copies"), F.min("least").alias("least"), F.min("first").alias("first"))
        return sums.select("cls", "copies", "least", F.col("first.id").alias("earliest"))

    def copies(self, per_task: int = PER_TASK) -> DataFrame:
        """(keep_id, copy_id): every member of a class of several, but the smallest, with the smallest."""
        keys = cut(self._by_key())
        many = keys.groupBy("cls").agg(F.sum("copies").alias("all"), F.min("least").alias("keep_id")).where("all > 1")
        keep = cut(keys.select("key", "cls", "copies").join(many, "cls").select("key", "copies", "keep_id"))
        members = join_on_unique(self.known(), keep, ["key"], "copies", per_task)
        return members.where("id != keep_id").select("keep_id", F.col("id").alias("copy_id"))


def attacks_ledger(spark: SparkSession, folder: str) -> Ledger:
    """The ledger of a folder's attacks, added by the quarter in which rows were loaded."""
    quarter = F.date_format(F.date_trunc("quarter", F.col("loaded_at").cast("timestamp")), "yyyy-MM")
    ledger = Ledger(spark)
    ledger.load(table(spark, folder, "attacks").select(F.col("attack_id").alias("id"), "category", "text", F.col("seen_at").cast("timestamp_ntz").alias("seen"), quarter.alias("batch")))
    return ledger


EMPTY_COPIES = "keep_id string, copy_id string"
EMPTY_RECORDS = "keep_id string, earliest_id string, copies bigint"


def found(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_id, copy_id) over the attacks; none for an empty table."""
    ledger = attacks_ledger(spark, folder)
    return ledger.copies() if ledger.at else spark.createDataFrame([], EMPTY_COPIES)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_id, earliest_id, copies): one row for each distinct attack."""
    ledger = attacks_ledger(spark, folder)
    if not ledger.at:
        return spark.createDataFrame([], EMPTY_RECORDS)
    return ledger.classes().select(F.col("least").alias("keep_id"), F.col("earliest").alias("earliest_id"), "copies")
