"""Same or near-same records across splits.

Same: records are hashed after problem-1 form, case, punctuation and white space are taken away
(sorted fields for field lists); evaluation hashes are joined with training hashes, and matches are
counted by split and source.

Nearly the same (word edit distance at most a fifth of the longer text) can't be seen by a hash, so
a second, exact stage follows on distinct word sequences. d edits break at most q d runs of q
words, so two near texts share a known number of runs; in any common order of runs several of them
then lie among the first of each (a prefix filter with a count). Rare runs come first, by a
fixed-size count of hashed runs, so what is common in the corpus joins only texts that consist of
little else. Texts that meet in a run but can't be near go before anything is counted: their lengths, the
run's place in both, or the parities of their words differ by more than the edits allow. Candidates are
verified by a bit-parallel edit distance over the whole word sequences. Copies meet only at the end, when
pairs of texts become pairs of records.

Large tables take several rounds, by the length of the evaluation text; what a step has shuffled or kept is
removed once the next table is written, so the disk holds one step of one round at a time.

Cases: records without id or text are left out; texts without letters are the same as each other
and near to none; texts of fewer than four words are near to none, since an edit needs five words on
one side; repeated rows of an id count
once. Labels and categories may be NULL (source '').
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.llm.canon import folded, key128, letters_of, words_of
from palimpsest.llm.ledger import key_classes, list_fields
from palimpsest.operators.lineage import cut, discard, keep
from palimpsest.operators.skew import join_on_unique
from palimpsest.operators.tables import table

#: Counters of the run frequencies that order the runs: 2 MB on every executor at any scale.
SKETCH = 1 << 18
#: Edits allowed: one in SHARE words of the longer text.
SHARE = 5
#: Runs of the rarest that near texts must share; more cost longer look-ups and save verifications.
MUST = 4
#: Texts are looked up by runs of three words, short ones by runs of two.
LONG_FROM, SHORT_TO = 10, 13
#: Words of the texts of one round, unless that makes more than MOST_ROUNDS. Texts that share one leading
#: part of their length (six bits) stay in one round.
ROUND_WORDS, MOST_ROUNDS = 50_000_000, 8


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, tab, split, source, train, text) of attacks, clean_docs and hard_cases."""
    attacks = table(spark, folder, "attacks").select(F.col("attack_id").alias("id"), F.lit("attacks").alias("tab"), "split", letters_of(folded(F.col("category"))).alias("source"), "text")
    docs = table(spark, folder, "clean_docs").select(F.col("doc_id").alias("id"), F.lit("clean_docs").alias("tab"), "split", F.col("domain").alias("source"), "text")
    cases = table(spark, folder, "hard_cases").select(
        F.col("case_id").alias("id"), F.lit("hard_cases").alias("tab"), F.lit("hard_cases").alias("split"), F.concat(F.lit("label "), F.col("label")).alias("source"), "text"
    )
    rows = attacks.unionByName(docs).unionByName(cases)
    kept = rows.where("split in ('train', 'validation', 'test', 'hard_cases') and id is not null and text is not null")
    return kept.select("id", "tab", "split", F.coalesce("source", F.lit("")).alias("source"), (F.col("split") == "train").alias("train"), "text")


def prefix_table(longest: int, q: int) -> np.ndarray:
    """By number of words n: how many of a text's rarest runs of q words are looked up, and how many
    of them a near text must share.

    Near texts of n and up to 5/4 n words share at least M - q + 1 - q floor(M / 5) runs; if of those
    l are to lie among the rarest of both, all but that number less l have to be looked up.
    """
    m = np.arange(2 * longest + 8)
    shared = m - q + 1 - q * (m // SHARE)
    out = np.zeros((longest + 1, 2), np.int64)
    for n in range(q, longest + 1):
        fewest = max(1, shared[n : n * SHARE // (SHARE - 1) + 2].min())
        must = min(MUST, fewest)
        out[n] = n - q + 1 - fewest + must, must
    return out


def runs_of(words: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of the runs of q words of many texts, whose words lie one after another up to
    ``ends``; the k-th repeat of a run in a text is a run of its own, and runs that are repeated have the
    place -1. Of two near texts both have LONG_FROM words or more (q = 3), or both have SHORT_TO words or
    less (q = 2); others have no runs."""
    n = np.diff(ends)
    wanted = (n >= LONG_FROM) if q == 3 else (n >= SHARE - 1) & (n <= SHORT_TO)
    number = np.where(wanted, n - q + 1, 0)
    text = np.repeat(np.arange(len(n)), number)
    place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    at = place + ends[:-1][text]
    w = words.view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), q, np.uint64)
        for k in range(q):
            h = (h ^ w[at + k] ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        order = np.lexsort((h, text))
        s, t = h[order], text[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(s)])
        repeat = np.arange(len(s)) - np.repeat(first, times)
        place = np.where(np.repeat(times, times) == 1, place[order], -1)
        s = (s + repeat.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        return t, s ^ (s >> np.uint64(32)), place


def parities(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits a text, none of them empty: whether the number of its words of one hash is odd. An edit changes
    at most two of them."""
    bits = np.uint64(1) << (words.view(np.uint64) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, ends[:-1]) if len(bits) else np.zeros(0, np.uint64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("words")
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        words, ends = _flat(batch)
        for q in (2, 3):
            _, h, _ = runs_of(words, ends, q)
            counts += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.int64)
        tables = {q: prefix_table(64, q) for q in (2, 3)}
        for batch in batches:
            words, ends = _flat(batch)
            n = np.diff(ends)
            parity = parities(words, ends).view(np.int64)
            for q in (2, 3):
                if n.max(initial=0) >= len(tables[q]):
                    tables[q] = prefix_table(2 * int(n.max()), q)
                t, h, place = runs_of(words, ends, q)
                if not len(t):
                    continue
                order = np.lexsort((h, counts[(h % np.uint64(SKETCH)).astype(np.int64)], t))
                t, h, place = t[order], h[order], place[order]
                start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                rank = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
                size, must = tables[q][n].T
                first = rank < size[t]
                t, h, place = t[first], h[first], place[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column("no").take(pa.array(t)), pa.array(parity[t])]
                    + [pa.array(x.astype(np.int32)) for x in (n[t], place, must[t] + 100 * q)],
                    ["run", "no", "parity", "n", "place", "must"],
                )

    return run


def word_distance_within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``most`` (bit-parallel)."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) > len(b):
        a, b = b, a
    while a and a[-1] == b[-1]:  # what both end or begin with costs nothing
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    m = len(a)
    if not m:
        return len(b) <= most
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, w in enumerate(b):
        eq = where.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return False
        up = (up << 1 | 1) & full
        plus = (down << 1 | (full & ~(d | up))) & full
        minus = up & d
    return score <= most


def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        most = max(len(x), len(y)) // SHARE
        rest = {}
        for w in x:
            rest[w] = rest.get(w, 0) + 1
        common = 0
        for w in y:
            if rest.get(w, 0) > 0:
                rest[w] -= 1
                common += 1
        out.append(max(len(x), len(y)) - common <= most and word_distance_within(x, y, most))
    return pa.array(out, pa.bool_())


def rounds(words_by_length: list[tuple[int, int]], words: int = 0, most: int = 0) -> list[tuple[int, int]]:
    """(from, to) of lengths, ``to`` excluded: every length is in one of them, and each takes lengths that
    hold about ``words`` words, or more of them so that there are about ``most`` rounds."""
    limit = max(words or ROUND_WORDS, sum(w for _, w in words_by_length) // (most or MOST_ROUNDS))
    starts, held = [0], 0
    for n, w in sorted(words_by_length):
        if held and held + w > limit:
            starts.append(n)
            held = 0
        held += w
    return list(zip(starts, [*starts[1:], 2**31 - 1]))


def may_be_near() -> Column:
    """Of runs met (ne, pe, be; nt, pt, bt): False where the texts are too far apart, by their lengths, by the
    words before and after the run if neither text repeats it, or by the parities of their words."""
    edits = F.floor(F.greatest("ne", "nt") / SHARE)
    moved = F.abs(F.col("pe") - F.col("pt")) + F.abs((F.col("ne") - F.col("pe")) - (F.col("nt") - F.col("pt")))
    return (
        (F.abs(F.col("ne") - F.col("nt")) <= edits)
        & ((F.least("pe", "pt") < 0) | (moved <= edits))
        & (F.bit_count(F.col("be").bitwiseXOR(F.col("bt"))) <= 2 * edits)
    )


def met_texts(evaluation: DataFrame, training: DataFrame, shared) -> DataFrame:
    """(e, t, must), as often as the texts (no, words) numbered e and t meet and may be near."""

    def prefixes(side: DataFrame, x: str) -> DataFrame:
        runs = side.select("no", "words").mapInArrow(_prefixes(shared), "run bigint, no bigint, parity bigint, n int, place int, must int")
        return runs.select("run", F.col("no").alias(x), F.col("parity").alias(f"b{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("must").alias(f"m{x}"))

    return prefixes(evaluation, "e").join(prefixes(training, "t"), "run").where(may_be_near()).select("e", "t", F.least("me", "mt").alias("must"))


def near_texts(texts: DataFrame) -> DataFrame:
    """(e, t): keys of evaluation and training texts (no, n, train, w, words) that are near and not equal."""
    spark = texts.sparkSession
    cells = texts.select("words").mapInArrow(_count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    for r in cells:
        counts[r["cell"]] = r["n"]
    shared = spark.sparkContext.broadcast(counts.tobytes())
    leading = F.expr("n - n % cast(pow(2, greatest(length(bin(n)) - 6, 0)) as int)").alias("from")
    lengths = texts.groupBy(leading).agg(F.sum(F.col("n").cast("bigint")).alias("words")).collect()  # at most 32 rows for each bit of the longest
    parts = []
    for low, high in rounds([(r["from"], r["words"]) for r in lengths]):
        left = texts.where(f"not train and n >= {low} and n < {high}")
        right = texts.where(f"train and n >= {low - low // SHARE} and n <= {min(2**31 - 1, (high - 1) * SHARE // (SHARE - 1))}")
        # `must` holds 100 q + l, so texts met by runs of both lengths are counted for each by itself
        met = met_texts(left, right, shared).groupBy("e", "t", "must").count().where("count >= must % 100")
        candidates = keep(met.select("e", "t").distinct(), drop_shuffles=True)
        left = left.select(F.col("no").alias("e"), F.col("w").alias("e_w"), F.col("words").alias("we"))
        right = right.select(F.col("no").alias("t"), F.col("w").alias("t_w"), F.col("words").alias("wt"))
        both = candidates.join(left, "e").join(right, "t").where("e_w != t_w")
        parts.append(keep(both.where(arrow_udf(_near, "boolean")(F.col("we"), F.col("wt"))).select(F.col("e_w").alias("e"), F.col("t_w").alias("t")), drop_shuffles=True))
        discard(candidates)
    return reduce(DataFrame.unionByName, parts)


def overlaps(rows: DataFrame) -> DataFrame:
    """(e_id, t_id, same, tab, split, source): pairs of an evaluation and a training record; the last
    three are the evaluation record's."""
    fold = rows.withColumn("fold", folded(F.col("text"))).drop("text")
    fields = list_fields(F.col("fold"))
    each = fold.withColumn("each", words_of(F.col("fold")))
    keyed = keep(
        each.select(
            "id", "tab", "split", "source", "train",
            key128(F.array_join("each", "")).alias("key"),  # all letters and digits
            F.when(fields.isNotNull(), key128(F.array_join(fields, "\u0002"), "list")).alias("alt"),
            F.transform("each", lambda x: F.xxhash64(x)).alias("words"),
        ).withColumn("w", key128(F.col("words"), "words"))
    )
    once = keyed.groupBy("id").agg(F.min(F.struct("tab", "split", "source", "train", "key", "alt", "w")).alias("m"))
    first = keep(once.select("id", "m.*"), drop_shuffles=True)
    classes = cut(key_classes(first.select("key", "alt")))
    members = keep(join_on_unique(first, classes, ["key"], "n").drop("key", "alt", "n"), drop_shuffles=True)
    discard(first)
    e, t = members.where("not train").select(F.col("id").alias("e_id"), "tab", "split", "source", "cls", F.col("w").alias("e")), members.where("train").select(F.col("id").alias("t_id"), "cls", F.col("w").alias("t"))
    same = e.join(t, "cls").select("e_id", "t_id", F.lit(True).alias("same"), "tab", "split", "source")
    distinct = keyed.where(F.size("words") >= SHARE - 1).groupBy("train", "w").agg(F.any_value("words").alias("words")).withColumn("n", F.size("words"))
    texts = keep(distinct.sortWithinPartitions("n").withColumn("no", F.monotonically_increasing_id()), drop_shuffles=True)
    discard(keyed)
    near = near_texts(texts)
    discard(texts)
    e2, t2 = e.withColumnRenamed("cls", "ce"), t.withColumnRenamed("cls", "ct")
    almost = near.join(e2, "e").join(t2, "t").where("ce != ct").select("e_id", "t_id", F.lit(False).alias("same"), "tab", "split", "source")
    return same.unionByName(almost)


def found(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("e_id", "t_id").alias("id_lo"), F.greatest("e_id", "t_id").alias("id_hi"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """(tab, split, source, pairs, same, records): overlaps by the evaluation record's split and source."""
    return pairs.groupBy("tab", "split", "source").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("same").cast("bigint")).alias("same"), F.countDistinct("e_id").alias("records")
    )
