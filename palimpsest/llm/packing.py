"""Filling fixed-capacity containers with items: documents into contexts of a public tokenizer.

Hierarchical residual packing. Documents are counted in tokens; one longer than the capacity is cut
into full contexts and a rest, all others stay whole. Items meet in groups of bounded size and are
packed best-fit, longest first; nearly full bins are done. Two bins of at most half the capacity never
leave a group apart, so each group has one such bin at most. These small bins are what can still be
joined: they are spread over groups of the underfull bins (each may fit into one), and those left meet
each other in a tree of groups, GROUP times fewer at each level. The rounds end when one small bin is
left at most, so whatever the size, at most one context is half empty, and a bin that is done has no
room for any small bin of its last group.

Cases: NULL, empty and token-less texts need no room and have no rows; a NULL doc_id is left out;
repeated rows of a doc_id count once, with the smallest size; ties are broken by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.operators.lineage import cut

CAPACITY = 2048
#: Where the public tokenizers' files are, and the vocabulary that sizes are counted in.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Items that one task packs, and the share of a bin's room that must be used to be done with it.
GROUP, NEARLY_FULL = 500, 0.995

_encoders: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer of a file, read once per process; special tokens in a text are ordinary text."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda texts: [len(e.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _encoders[path] = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _encoders[path]


def token_count(text, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """Tokens of a text column; NULL for NULL."""
    path = f"{folder}/{vocabulary}"

    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        sizes = iter(_encoder(path)([t for t in given if t is not None]))
        return pa.array([None if t is None else next(sizes) for t in given], pa.int32())

    return arrow_udf(run, "int")(text)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, longest first, each into the fullest bin that has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has r left
    out, bins = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        rooms[r - s].append(b)
        free |= 1 << r - s
    return out


def _pack_group(capacity: int, turn: int):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        where = best_fit(items["size"].tolist(), capacity)
        return pd.DataFrame({"item": items["item"], "size": items["size"], "bin": [f"{turn}-{key[0]}-{b}" for b in where]})

    return pack


def _round(items: DataFrame, count: int, capacity: int, turn: int, group: int) -> DataFrame:
    """(item, size, bin) of items (item, size), packed in groups of about ``group``."""
    groups = max(1, -(-count // group))
    keyed = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(groups)).cast("int"))
    return cut(keyed.groupBy("g").applyInPandas(_pack_group(capacity, turn), "item string, size int, bin string"))


def _merged(bins: DataFrame, moved: DataFrame) -> DataFrame:
    """(bin, to, size) of every first bin, after the bins of a round (item, size, bin) went into others."""
    sums = moved.groupBy("bin").agg(F.sum("size").cast("int").alias("sum"))
    where = moved.join(sums, "bin").select(F.col("item").alias("to"), F.col("bin").alias("next"), "sum")
    joined = bins.join(where, "to", "left")
    return cut(joined.select("bin", F.coalesce("next", "to").alias("to"), F.coalesce("sum", "size").alias("size")))


def pack(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, part, parts, tokens, context): where each part of each document (doc_id, tokens) goes."""
    counted = sizes.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.min("tokens").alias("tokens"))
    full, rest = F.floor(F.col("tokens") / capacity), F.col("tokens") % capacity
    parts = cut(
        counted.withColumn("parts", (full + (rest > 0).cast("int")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("doc_id", "part", "parts", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("size"))
    )
    name = F.concat_ws(":", "doc_id", "part")
    items = parts.where(F.col("size") < capacity).select(name.alias("item"), "size")
    placed = _round(items, items.count(), capacity, 0, group)
    bins = cut(placed.groupBy("bin").agg(F.sum("size").cast("int").alias("size")).select("bin", F.col("bin").alias("to"), "size"))
    turn, half = 0, capacity // 2
    while True:
        small, least = bins.where(F.col("size") <= half).agg(F.countDistinct("to"), F.min("size")).first()
        if small < 2:
            break
        # spread: the small bins over groups of those that have room for the smallest of them
        under = cut(bins.where((F.col("size") < NEARLY_FULL * capacity) & (F.col("size") + least <= capacity)).select(F.col("to").alias("item"), "size").distinct())
        turn += 1
        bins = _merged(bins, _round(under, under.count(), capacity, turn, group))
        # tree: those that are left, among themselves
        rest_ = cut(bins.where(F.col("size") <= half).select(F.col("to").alias("item"), "size").distinct())
        left = rest_.count()
        if left > 1:
            turn += 1
            bins = _merged(bins, _round(rest_, left, capacity, turn, group))
    where = placed.join(bins.select("bin", "to"), "bin").select("item", "to")
    done = parts.withColumn("item", F.when(F.col("size") < capacity, name)).join(where, "item", "left")
    return done.select("doc_id", "part", "parts", F.col("size").alias("tokens"), F.coalesce("to", F.concat(F.lit("whole-"), name)).alias("context"))


def contexts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """pack() of documents (doc_id, text), sized by a public tokenizer."""
    return pack(documents.select("doc_id", token_count(F.col("text"), folder, vocabulary).alias("tokens")), capacity)


def found(packed: DataFrame) -> DataFrame:
    """(doc_id) of the documents that had to be cut."""
    return packed.where("parts > 1 and part = 0").select("doc_id")


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(contexts, tokens, fewest, fill, largest, half_empty, cut_short): contexts used and the fewest that
    any packing could use; the fullest; contexts of at most half the capacity (1 at most); documents
    within the capacity that were cut (none)."""
    used = packed.groupBy("context").agg(F.sum("tokens").alias("t"))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    cuts = docs.agg(F.coalesce(F.sum(((F.col("t") <= capacity) & (F.col("n") > 1)).cast("bigint")), F.lit(0)).alias("cut_short"))
    totals = used.agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / capacity).alias("fewest"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 4).alias("fill"), F.max("t").alias("largest"),
        F.coalesce(F.sum((F.col("t") <= capacity // 2).cast("bigint")), F.lit(0)).alias("half_empty"),
    )
    return totals.join(cuts)  # one row each
