"""Splits that keep related records together.

1. ``tie_edges``: each tying value (an author within a domain, an origin) makes one star from its
   members to the smallest of them, so a value held by a third of all rows makes that many edges and
   no pairs. 2. ``components``: the stars are joined by alternating large-star and small-star rounds
   until nothing changes; every round is cut into the shared folder. 3. ``balance``: components are
   laid into many equal bins by largest differencing, in bounded blocks and then block by block, and
   whole bins are given to the splits by their proportions. Nothing that grows with the data is
   collected: the driver sees one row per bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canon import folded
from palimpsest.operators.lineage import cut
from palimpsest.operators.skew import PER_TASK, join_on_unique
from palimpsest.operators.tables import table

#: Values that tie nothing, in any case.
NO_TIE = ("", "unknown", "n/a", "anonymous")
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Equal bins to fill; every split gets whole bins, so proportions are met to 1/BINS.
BINS = 100
#: Components per differencing block; components per lane (blocks of a lane follow one another) and
#: the most lanes, so that at most MOST_LANES * BINS rows of totals reach the driver.
BLOCK, LANE, MOST_LANES = 5_000, 1_000_000, 1_000


def tie_value(value: Column) -> Column:
    """A tying value in problem-1 form, lower case, without outer blanks; NULL if it ties nothing."""
    v = F.trim(folded(value))
    return F.when(~v.isin(*NO_TIE), v)


def doc_key(doc_id: Column) -> Column:
    """A clean document's id however spelled: form, lower case, no blanks outside, hyphens."""
    return F.translate(F.trim(folded(doc_id)), "_", "-")


def chunk_doc_key(doc_id: Column) -> Column:
    """The clean document's key in a chunk's doc_id, without its variant suffix."""
    return F.regexp_replace(doc_key(doc_id), "-v[0-9]+$", "")


def tie_edges(docs: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(u, v), u > v, for records (id, domain, author, origin): members of one value, to its smallest."""
    values = F.array_compact(
        F.array(
            F.when(F.col("domain").isNotNull() & F.col("a").isNotNull(), F.concat_ws("\u0001", F.lit("a"), "domain", "a")),
            F.when(F.col("o").isNotNull(), F.concat_ws("\u0001", F.lit("o"), "o")),
        )
    )
    held = cut(
        docs.where("id is not null")
        .select("id", "domain", tie_value(F.col("author")).alias("a"), tie_value(F.col("origin")).alias("o"))
        .select("id", F.explode(values).alias("value"))
    )
    # Values of a single row are gone before the join; min and max combine on the map side.
    least = held.groupBy("value").agg(F.min("id").alias("v"), F.max("id").alias("w"), F.count(F.lit(1)).alias("n")).where("v != w").select("value", "v", "n")
    return join_on_unique(held, least, ["value"], "n", per_task).where("id != v").select(F.col("id").alias("u"), "v").distinct()


def _large_star(edges: DataFrame, per_task: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_on_unique(both.where("v > u"), least, ["u"], "n", per_task).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, per_task: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_on_unique(edges, least, ["u"], "n", per_task).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, per_task: int = PER_TASK) -> DataFrame:
    """(id, group): every vertex of the edges (u, v) with the smallest vertex of its component.

    No edges give no rows. Raises if most_rounds rounds don't settle it (the number of rounds grows
    with the logarithm of the vertices).
    """
    pairs = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        pairs = cut(_small_star(_large_star(pairs, per_task), per_task))
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("group")).union(roots)


def related_docs(clean_docs: DataFrame) -> DataFrame:
    """(id, group) of clean documents tied to at least one other, both as stored."""
    return components(tie_edges(clean_docs.select(F.col("doc_id").alias("id"), "domain", "author", "origin")))


def largest_differencing(weights: list[float], bins: int) -> tuple[list[int], list[float]]:
    """The bin of each weight and the bins' totals, by multi-way largest differencing.

    The two partial partitions of largest spread are merged, fullest bin with emptiest, until one
    is left. No weights give empty bins; equal weights are taken in their order.
    """
    if not weights:
        return [], [0.0] * bins
    # A partial partition: non-empty bins in descending order of total, each with its members.
    heap = [(-w, i, [(w, [i])]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, p = heapq.heappop(heap)
        _, _, q = heapq.heappop(heap)
        full = p + [(0.0, [])] * (bins - len(p))
        small = q + [(0.0, [])] * (bins - len(q))
        r = [(a + b, x + y) for (a, x), (b, y) in zip(full, reversed(small)) if x or y]
        r.sort(key=lambda t: -t[0])
        tie += 1
        heapq.heappush(heap, (-(r[0][0] - (r[-1][0] if len(r) == bins else 0.0)), tie, r))
    final = heap[0][2]
    where, totals = [0] * len(weights), [0.0] * bins
    for k, (w, members) in enumerate(final):
        totals[k] = w
        for i in members:
            where[i] = k
    return where, totals


def _fill_lanes(bins: int):
    """Batches sorted by lane, heaviest first, with the bin of each row; every lane fills bins of its own."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, totals = None, [0.0] * bins
        for batch in batches:
            for own, rows in batch.groupby("lane", sort=True):
                if own != lane:
                    lane, totals = own, [0.0] * bins
                for at in range(0, len(rows), BLOCK):
                    part = rows.iloc[at : at + BLOCK]
                    where, sums = largest_differencing(part["weight"].astype(float).tolist(), bins)
                    # the block's fullest bin joins the lane's emptiest
                    down = sorted(range(bins), key=lambda k: -sums[k])
                    up = sorted(range(bins), key=lambda k: totals[k])
                    to = dict(zip(down, up))
                    for k in range(bins):
                        totals[to[k]] += sums[k]
                    yield pd.DataFrame({"group": part["group"], "weight": part["weight"], "lane": part["lane"], "bin": [to[k] for k in where]})

    return fill


def allocate(totals: dict[tuple[int, int], float], bins: int, splits: dict[str, float]) -> dict[tuple[int, int], str]:
    """The split of each (lane, bin): lanes are differenced into global bins, bins go whole to the
    split that lacks most; ties go to the split named first."""
    lanes: dict[int, list[float]] = {}
    for (lane, k), w in totals.items():
        lanes.setdefault(lane, [0.0] * bins)[k] = w
    sums, to = [0.0] * bins, {}
    for lane in sorted(lanes, key=lambda n: min(lanes[n]) - max(lanes[n])):
        down = sorted(range(bins), key=lambda k: -lanes[lane][k])
        up = sorted(range(bins), key=lambda k: sums[k])
        for k, g in zip(down, up):
            to[lane, k] = g
            sums[g] += lanes[lane][k]
    whole = sum(sums)
    lack = {name: share * whole for name, share in splits.items()}
    given = {}
    for g in sorted(range(bins), key=lambda g: -sums[g]):
        name = max(lack, key=lack.__getitem__)
        given[g] = name
        lack[name] -= sums[g]
    return {key: given[g] for key, g in to.items()}


def balance(groups: DataFrame, splits: dict[str, float] = SPLITS, bins: int = BINS, lane: int = LANE) -> DataFrame:
    """(group, weight, split) for groups (group, weight): whole groups, splits near their proportions.

    An empty table gives an empty one. A group heavier than a split's share goes to the split with
    the largest share, and the rest is balanced around it.
    """
    spark = groups.sparkSession
    groups = cut(groups.select("group", F.col("weight").cast("double").alias("weight")))
    lanes = max(1, min(MOST_LANES, -(-groups.count() // lane)))
    laid = cut(
        groups.withColumn("lane", F.pmod(F.xxhash64("group"), F.lit(lanes)).cast("int"))
        .repartition(lanes, "lane").sortWithinPartitions("lane", F.desc("weight"), "group")
        .mapInPandas(_fill_lanes(bins), "group string, weight double, lane int, bin int")
    )
    totals = {(r["lane"], r["bin"]): r["w"] for r in laid.groupBy("lane", "bin").agg(F.sum("weight").alias("w")).collect()}
    rows = [(lane, k, name) for (lane, k), name in allocate(totals, bins, splits).items()]
    where = spark.createDataFrame(rows, "lane int, bin int, split string")
    return laid.join(F.broadcast(where), ["lane", "bin"]).select("group", "weight", "split")


def chunk_keys(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_key): each chunk's clean document; repeated chunks count once.

    A chunk without doc_id takes the document its chunk_id begins with.
    """
    own = F.coalesce(chunk_doc_key(F.col("doc_id")), chunk_doc_key(F.regexp_replace("chunk_id", "-[0-9]+$", "")))
    return chunks.where("chunk_id is not null").select("chunk_id", own.alias("doc_key")).groupBy("chunk_id").agg(F.min("doc_key").alias("doc_key"))


def given(chunks: DataFrame, clean_docs: DataFrame, splits: dict[str, float] = SPLITS) -> DataFrame:
    """(doc_key, n, tied, group, split): every clean document that chunks speak of, the number of its
    chunks, whether it is tied to another, its component (or itself), and the split of the whole component."""
    held = chunk_keys(chunks).groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"))
    named = chunks.where("doc_id is not null").select(chunk_doc_key(F.col("doc_id")).alias("doc_key")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    weights = held.unionByName(named).groupBy("doc_key").agg(F.sum("n").alias("n"))
    groups = related_docs(clean_docs).groupBy(doc_key(F.col("id")).alias("doc_key")).agg(F.min("group").alias("group"))
    grouped = cut(weights.join(groups, "doc_key", "left").select("doc_key", "n", F.col("group").isNotNull().alias("tied"), F.coalesce("group", "doc_key").alias("group")))
    bins = balance(grouped.groupBy("group").agg(F.sum("n").alias("weight")), splits)
    return cut(grouped.join(bins.select("group", "split"), "group"))


def split_chunks(chunks: DataFrame, clean_docs: DataFrame, splits: dict[str, float] = SPLITS) -> DataFrame:
    """(chunk_id, group, split): every chunk's split; chunks of related documents share theirs."""
    docs = given(chunks, clean_docs, splits)
    return join_on_unique(chunk_keys(chunks), docs, ["doc_key"], "n").select("chunk_id", "group", "split")


def found(chunks: DataFrame, clean_docs: DataFrame) -> DataFrame:
    """(doc_id, group_id): each distinct stored chunk doc_id whose document is tied to another, of the
    components that were laid into bins and given to a split."""
    ids = chunks.where("doc_id is not null").select("doc_id").distinct().withColumn("doc_key", chunk_doc_key(F.col("doc_id")))
    tied = given(chunks, clean_docs).where("tied and split is not null").select("doc_key", "group")
    return ids.join(tied, "doc_key").select("doc_id", F.col("group").alias("group_id"))


def tables(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "chunks"), table(spark, folder, "clean_docs")
