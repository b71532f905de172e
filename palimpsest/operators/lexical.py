"""Training and scores of the lexical model (models.train_tfidf) on whole batches.

A gram lies within what blanks part, so a text's grams are those of its pieces. A block of texts holds each of
its pieces' grams once and its texts as lists of pieces: a step of the training looks up about 70 pieces a text,
not 1,000 grams. Texts that are the same, under the same label, are one row with a weight.

Two passes over the texts (what occurs how often; the known terms as numbers), then one over the blocks for each
value of the loss. Nothing is left out: terms, idf, lengths and the loss are those of every row.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut, discard, keep

#: Characters of a block (one text at least), pieces whose grams are counted at once. Slices of a gradient, which
#: SUMS tasks sum.
BLOCK, PIECES, SLICES, SUMS = 2_000_000, 50_000, 32, 4
KINDS = ("terms", "chars")
_PIECE = re.compile(r"[^ \t\n\x0b\f\r]+")  # what Spark's \s parts


class Rows:
    """Rows of numbers: ``flat`` one row after another, ``size`` how many each has."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> Rows:
        """From (numbers, row of each), rows ascending within each part."""
        flat, row = (np.concatenate(x) for x in zip(*parts))
        return cls(flat[np.argsort(row, kind="stable")], np.bincount(row, minlength=n))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def sums(self, of: np.ndarray) -> np.ndarray:
        """For each row, the sum of ``of`` at its numbers."""
        return np.bincount(self.row(), of[self.flat], len(self.size))

    def spread(self, of: np.ndarray, n: int) -> np.ndarray:
        """For each number under n, the sum of ``of`` over the rows it stands in, as often as it does."""
        return np.bincount(self.flat, np.repeat(of, self.size), n)

    def through(self, inner: Rows) -> Rows:
        """Each number replaced by the row of ``inner`` that it names."""
        n = inner.size[self.flat]
        begin = (np.cumsum(inner.size) - inner.size)[self.flat] - (np.cumsum(n) - n)
        return Rows(inner.flat[np.repeat(begin, n) + np.arange(n.sum())], np.bincount(self.row(), n, len(self.size)).astype(np.int64))

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, how often) of the different numbers, all under n, of each row."""
        both, often = np.unique(self.row() * max(1, n) + self.flat, return_counts=True)
        return *np.divmod(both, max(1, n)), often

    def some(self, most: int) -> Iterator[tuple[int, Rows]]:
        """In parts of at most ``most`` numbers (one row at least): the first row, and its rows."""
        ends, at = np.cumsum(self.size), 0
        while at < len(ends):
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
            yield at, Rows(self.flat[begin : ends[to - 1]], self.size[at:to])
            at = to

    def known(self, to: np.ndarray) -> Rows:
        """Renumbered by ``to``; numbers that it has at -1 go."""
        flat = to[self.flat]
        return Rows(flat[flat >= 0].astype(np.int32), np.bincount(self.row()[flat >= 0], minlength=len(self.size)))


def _encoded(strings: list[str] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different strings, and the place of each among them."""
    d = pa.array(strings, pa.string()).dictionary_encode() if isinstance(strings, list) else strings.cast(pa.string()).dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _terms(words: pa.ListArray) -> tuple[pa.Array, Rows]:
    """Words and pairs of neighbours: the different ones, and each text's."""
    names, ids = _encoded(words.flatten())
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    near = np.flatnonzero(row[1:] == row[:-1])
    pairs, at = np.unique(ids[near] * max(1, len(names)) + ids[near + 1], return_inverse=True)
    first, second = (names.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(names))))
    return pa.concat_arrays([names, pc.binary_join_element_wise(first, second, " ")]), Rows.of([(ids, row), (at + len(names), row[near])], len(words))


def _chars(texts: list[str]) -> tuple[pa.Array, Rows, Rows]:
    """The different grams of 3-5 characters, each text's pieces, and each piece's grams."""
    each = [_PIECE.findall(t) for t in texts]
    names, ids = _encoded(list(chain.from_iterable(each)))
    padded, found, parts, n = [f" {w} " for w in names.to_pylist()], [], [], 0
    sizes = np.array([len(w) for w in padded], np.int64)
    for k in (3, 4, 5):
        grams, at = _encoded([w[i : i + k] for w in padded for i in range(len(w) - k + 1)])
        parts.append((at + n, np.repeat(np.arange(len(padded)), np.maximum(sizes - k + 1, 0))))
        found.append(grams)
        n += len(grams)
    return pa.concat_arrays(found), Rows(ids, np.array([len(x) for x in each], np.int64)), Rows.of(parts, len(padded))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Rows(np.zeros(0), pc.utf8_length(batch.column("low")).to_numpy(zero_copy_only=False))
        for at, block in texts.some(BLOCK):
            yield batch.slice(at, len(block.size))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        weight = block.column("weight").to_numpy(zero_copy_only=False)
        terms, of_text = _terms(block.column("words"))
        chars, pieces, of_piece = _chars(block.column("low").to_pylist())
        for kind, names, rows, inner in ((0, terms, of_text, None), (1, chars, pieces, of_piece)):
            n, df = np.zeros(len(names)), np.zeros(len(names))
            for at, own in rows.some(PIECES):
                row, number, often = (own.through(inner) if inner else own).counted(len(names))
                n += np.bincount(number, often * weight[at + row], len(names))
                df += np.bincount(number, weight[at + row], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), names, pa.array(n.astype(np.int64)), pa.array(df.astype(np.int64))], ["kind", "gram", "n", "df"])


def _shares(rows: Rows, idf: np.ndarray, inner: Rows | None = None) -> np.ndarray:
    """By what a text's weights are multiplied so that they have unit length; 0 if there is none."""
    out = np.zeros(len(rows.size))
    for at, own in rows.some(PIECES):
        row, number, often = (own.through(inner) if inner else own).counted(len(idf))
        length = np.sqrt(np.bincount(row, (often * idf[number]) ** 2, len(own.size)))
        out[at : at + len(length)] = np.divide(1, length, out=np.zeros(len(length)), where=length > 0)
    return out


def _features(words: pa.ListArray, low: pa.Array, known: list[tuple[pa.Array, np.ndarray]]) -> tuple[Rows, np.ndarray, Rows, np.ndarray, Rows]:
    """The texts' known terms and by what their weights are multiplied; their pieces, the same, and the pieces' known grams."""
    (terms, term_idf), (chars, char_idf) = known
    places = lambda names, of: pc.fill_null(pc.index_in(names, of), -1).to_numpy(zero_copy_only=False)
    names, rows = _terms(words)
    rows = rows.known(places(names, terms))
    names, pieces, grams = _chars(low.to_pylist())
    grams = grams.known(places(names, chars))
    return rows, _shares(rows, term_idf), pieces, _shares(pieces, char_idf, grams), grams


def _encode(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            terms, term_share, pieces, char_share, grams = _features(block.column("words"), block.column("low"), shared.value)
            held = (
                block.column("label").to_numpy(zero_copy_only=False), block.column("weight").to_numpy(zero_copy_only=False).astype(float),
                terms.flat, terms.size.astype(np.int32), term_share,
                pieces.flat.astype(np.int32), pieces.size.astype(np.int32), char_share, grams.flat, grams.size.astype(np.int32),
            )
            raw = pickle.dumps(held, 5)
            yield pa.RecordBatch.from_arrays([pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], ["size", "block"])

    return run


def probability(spark: SparkSession, known: list[tuple[pa.Array, np.ndarray]], weights: np.ndarray, intercept: float) -> Callable[[Column, Column], Column]:
    """A function of the columns words and low."""
    shared = spark.sparkContext.broadcast((known, [w * idf for w, (_, idf) in zip(np.split(weights, [len(known[0][1])]), known)], intercept))

    @F.arrow_udf("double")
    def score(words: pa.Array, low: pa.Array) -> pa.Array:
        terms, (by_term, by_gram), least = shared.value
        out = [np.zeros(0)]
        for block in _blocks([pa.RecordBatch.from_arrays([words, low], ["words", "low"])]):
            own, term_share, pieces, char_share, grams = _features(block.column("words"), block.column("low"), terms)
            z = own.sums(by_term) * term_share + pieces.sums(grams.sums(by_gram)) * char_share + least
            out.append(np.exp(-np.logaddexp(0, -z)))
        return pa.array(np.concatenate(out))

    return score


def _gradient(shared, known: tuple[int, int]) -> Callable:
    """Of the blocks' losses by the weights of terms and grams (times their idf) and the intercept, then the losses'
    sum: (slice, part) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (n, m) = shared.value, known
        by_term, by_gram, out = at[:n], at[n : n + m], np.zeros(n + m + 2)
        for batch in batches:
            for size, block in zip(batch.column("size").to_pylist(), batch.column("block")):
                y, weight, a, b, term_share, c, d, char_share, e, f = pickle.loads(pa.decompress(block.as_buffer(), size, "zstd"))
                terms, pieces, grams = Rows(a, b), Rows(c, d), Rows(e, f)
                z = terms.sums(by_term) * term_share + pieces.sums(grams.sums(by_gram)) * char_share + at[-1]
                off = weight * (np.exp(-np.logaddexp(0, -z)) - y)
                out[:n] += terms.spread(off * term_share, n)
                out[n : n + m] += grams.spread(pieces.spread(off * char_share, len(f)), m)
                out[-2] += off.sum()
                out[-1] += (weight * (np.logaddexp(0, z) - y * z)).sum()
        yield _sliced(dict(enumerate(np.array_split(out, SLICES))))

    return run


def _sliced(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["slice", "part"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(part)
    yield _sliced(sums)


def vocabularies(rows: DataFrame, size: int, least: int = 2) -> list[tuple[pa.Array, np.ndarray]]:
    """For each kind its most frequent terms that ``least`` texts have, and in how many texts they are; rows (words,
    low, weight). Of equally frequent ones the first by their characters stay."""
    counts = rows.select("words", "low", "weight").mapInArrow(_count, "kind int, gram string, n bigint, df bigint")
    counts = keep(counts.groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= least), drop_shuffles=True)
    seen = counts.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("terms")).toArrow().to_pandas()  # a row for each different count
    out = []
    for kind in range(len(KINDS)):
        own = seen[seen["kind"] == kind].sort_values("n", ascending=False)
        enough = own["n"][own["terms"].cumsum() >= size]  # rarer ones have no place: no task orders them
        top = counts.where((F.col("kind") == kind) & (F.col("n") >= int(enough.max() if len(enough) else 0)))
        top = top.orderBy(F.desc("n"), "gram").limit(size).select("gram", "df").toArrow()
        out.append((pa.array(top["gram"].to_pylist(), pa.string()), top["df"].to_numpy().astype(float)))
    discard(counts)
    return out


def minimise(loss: Callable, x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with steps that meet Wolfe's conditions, for a loss(x) -> value, gradient; ends when ``memory`` steps
    together lower the value by less than ``tolerance`` of it. The values of all steps come second."""
    value, slope = loss(x)
    values, moves = [value], []
    while len(values) <= steps and np.isfinite(value):
        down, kept = -slope, []
        for s, y, r in reversed(moves):
            kept.append(r * (s @ down))
            down = down - kept[-1] * y
        if moves:
            s, y, r = moves[-1]
            down = down / (r * (y @ y))
        for (s, y, r), k in zip(moves, reversed(kept)):
            down = down + (k - r * (y @ down)) * s
        fall, lo, hi, t = slope @ down, 0.0, np.inf, 1.0 if moves else 1 / max(1e-12, np.sqrt(slope @ slope))
        for _ in range(30):
            if fall >= 0:
                break
            there, at = loss(x + t * down)
            if not there <= value + 1e-4 * t * fall:
                hi = t
            elif at @ down < 0.9 * fall:
                lo = t
            else:
                break
            t = (lo + hi) / 2 if hi < np.inf else 2 * lo
        else:
            break
        if fall >= 0:
            break
        move, turn = t * down, at - slope
        if move @ turn > 0:
            moves = [*moves, (move, turn, 1 / (move @ turn))][-memory:]
        x, value, slope = x + move, there, at
        values.append(value)
        if len(values) > memory and values[-memory - 1] - value <= tolerance * abs(value):
            break
    return x, values


def fit(rows: DataFrame, size: int, c: float, steps: int, tolerance: float = 1e-4) -> tuple[list[tuple[pa.Array, np.ndarray]], np.ndarray, float, list[float]]:
    """For each kind its terms and their idf; the weights, the intercept, the losses. Rows (words, low, label, weight)."""
    sc = rows.sparkSession.sparkContext
    n, positive = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.col("weight") * F.col("label")), F.lit(0.0))).first()
    known = [(names, np.log((1 + n) / (1 + df)) + 1) for names, df in vocabularies(rows, size)]
    if not all(len(names) for names, _ in known):
        raise ValueError("no term is in two texts")
    sizes, scale = tuple(len(names) for names, _ in known), np.concatenate([idf for _, idf in known])
    if positive in (0, n):  # one class: always answered
        return known, np.zeros(len(scale)), float("inf") if positive else float("-inf"), []
    shared = sc.broadcast(known)
    blocks = cut(rows.mapInArrow(_encode(shared), "size bigint, block binary")).coalesce(sc.defaultParallelism)
    shared.destroy()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        at = sc.broadcast(np.append(x[:-1] * scale, x[-1]))
        parts = blocks.mapInArrow(_gradient(at, sizes), "slice int, part binary").repartition(SUMS, "slice").mapInArrow(_add, "slice int, part binary").toArrow()
        at.destroy()
        total = np.concatenate([np.frombuffer(x.as_buffer()) for x in parts.sort_by("slice")["part"]]) / n
        slope, inner = np.append(total[:-2] * scale, total[-2]), x[:-1] / (c * n)
        slope[:-1] += inner
        return total[-1] + x[:-1] @ inner / 2, slope

    x, losses = minimise(loss, np.append(np.zeros(len(scale)), np.log(positive / (n - positive))), steps, tolerance)
    return known, x[:-1], float(x[-1]), losses
