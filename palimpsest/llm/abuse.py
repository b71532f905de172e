"""Abusive, hateful or sexual content: a score for every document and a rate for every source.

A document is read passage by passage (sentences and lines). Words are taken in problem-1 form and
lower case with disguises undone: letters spelled apart, digits and signs for letters, stretched
letters, and stars matched against the lexicon. Words run together (over LONG letters, or spelled
apart) are cut at the words the lexicon knows; no word is skipped. Texts are parsed once, into a table
of hashed words in the shared folder; everything after reads that table, and the work on it is done on
whole batches of hashes (64 bits; runs of words are hashes of hashes).

The lexicon holds runs of one to three words with their log-odds between labelled documents; public
swear words are in it from the start, and the whole corpus has its say on what mostly stands in
harmless passages. Every run with |weight| over 1 is kept. Features are dense: the largest lexicon
weight and density of a passage, how near a second person is to it, capitals, exclamation marks,
disguises. Gradient-boosted trees over them are fitted on the labelled documents, on features whose
lexicon never saw the document's label, and their scores are calibrated by isotonic regression on
scores of trees that never saw the document.

Only the lexicon and the trees come from a sample: at most MOST_LABELLED labelled documents, those
of smallest hash. Every document is scored, on its whole text.

Cases: documents without id are left out, repeated ones count once; NULL, empty and blank texts
score 0; labels that are NULL are ignored, a rater who contradicts themself counts with the mean of
what they said, documents whose raters disagree evenly are not used; without labels of both classes
there is nothing to learn and every score is NULL.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canon import transducer
from palimpsest.operators.lineage import cut, ensure_checkpoint_dir
from palimpsest.operators.tables import table

#: Labelled documents that are learned from at most; they also bound the lexicon.
MOST_LABELLED = 20_000
#: Labelled documents in which an entry must occur; folds; the score from which a document is reported.
LEAST_DOCS, FOLDS, THRESHOLD = 3, 4, 0.5

#: Times that the lexicon is learned from passages.
ROUNDS = 1
#: Summed weight from which what else is in a passage makes it abusive company.
COMPANY = 4.0
#: Words from which a passage tells something about the company of its entries.
TELLING = 6
#: Letters from which a word is taken for several run together.
LONG = 24

#: Insults and sexual words known beforehand (English, Italian, Spanish).
SEED = (
    "asshole bastard bitch cunt dickhead dumbass fuck fucking fucked motherfucker moron prick scumbag shithead slut "
    "whore faggot nigger retard horny nudes orgasm porn porno xxx tits loser pathetic worthless idiot imbecile stupid "
    "bastardo cazzo coglione cretino deficiente fottuto idiota imbecille merda puttana stronzo troia vaffanculo "
    "cabrón gilipollas hijoputa imbécil inútil maldito mierda pendejo puta zorra desgraciado asco desnuda desnudas sexo sesso nuda nude nudi"
).split()
SECOND = frozenset("you your yours yourself u ur tu ti te sei tuo tua vai eres vete tienes vosotros voi".split())

_ENDS = re.compile(r"([.!?])\s+")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]([-.*_ ]))(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])")
#: What every text with such letters holds; quicker to look for.
_MAYBE_APART = re.compile(r"[-.*_ ][^\W\d_][-.*_ ][^\W\d_][-.*_ ]")
_SEPARATOR = re.compile(r"[-.*_ ]")
#: Stands before a word that was spelled apart (a private character, taken out of texts beforehand).
_JOINED = ""
_LEET = str.maketrans("013457@$!|", "oieastasii")
_TOKEN = re.compile(rf"{_JOINED}?[^\W_]+(?:[*@$!|]+[^\W_]+)*|[@$][^\W_]+(?:[*@$!|]+[^\W_]+)*")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d+")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def word_hash(word: str) -> int:
    """What xxhash64() of a string column gives."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_word(raw: str) -> tuple[str, int, bool]:
    """(word, disguises undone, whether the lexicon has to look at its letters)."""
    joined = raw[0] == _JOINED
    if joined:
        raw = raw[1:]
    w = raw.lower() if raw.isascii() else transducer().fold(raw)
    disguised = int(joined)
    if not w.isalpha():
        if w.isdigit():
            w = "#"
        elif "*" in w:
            disguised += 1
        else:
            plain = w.translate(_LEET)
            if plain.isalpha() and sum(map(str.isdigit, w)) * 2 <= len(w) + 2:
                w = plain
                disguised += 1
            else:
                w = _NUMBER.sub("#", w)
    short = _STRETCH.sub(r"\1", w)
    if short != w:
        disguised += 1
        w = short
    elif raw[1:] != raw[1:].lower() and raw[1:] != raw[1:].upper():
        disguised += 1
    if len(w) > LONG and not w.replace("*", "").isalpha():
        w = "#long"  # an encoded blob: a word of its own, so its neighbours don't meet
    return w, disguised, "*" in w or joined and len(w) > 7 or len(w) > LONG


Token = tuple[int, int, str | None, str]
#: Of ASCII, what parts words whatever stands beside it.
_PARTS = bytes(c if chr(c).isalnum() or chr(c) in "*@$!|" else 32 for c in range(128)) + bytes(128)


class Memo(dict):
    """Pieces of text to (hash, disguises, the word itself if it is odd, the word) of the words in them."""

    MOST = 300_000  # kept per process; beyond it pieces are read again

    def __missing__(self, piece: str | bytes) -> tuple[Token, ...]:
        out = []
        for raw in _TOKEN.findall(piece if isinstance(piece, str) else piece.decode()):
            w, disguised, odd = plain_word(raw)
            out.append((word_hash(w), disguised, w if odd else None, w))
        known = tuple(out)
        if len(self) < self.MOST:
            self[piece] = known
        return known


class Reader:
    """Texts to passages of hashed words; what was met once is kept."""

    def __init__(self) -> None:
        self.memo = Memo()

    def passages(self, text: str | None) -> Iterator[tuple[list[Token], float, float]]:
        """(words, share of capitals, marks in a hundred characters) of each passage."""
        if not text or text.isspace():
            return
        shown = transducer().apply(text).replace(_JOINED, "")
        if _MAYBE_APART.search(shown):
            shown = _APART.sub(lambda m: _JOINED + _SEPARATOR.sub("", m.group()), shown)
        memo = self.memo
        for p in _ENDS.sub("\\1\n", shown).split("\n"):
            if not p or p.isspace():
                continue
            if p.isascii():
                b = p.encode()
                letters, capitals = len(b) - len(b.translate(None, _LETTERS)), len(b) - len(b.translate(None, _UPPER))
                pieces = b.translate(_PARTS).split()
            else:
                letters, capitals = sum(map(str.isalpha, p)), sum(map(str.isupper, p))
                pieces = _TOKEN.findall(p)
            marks = (p.count("!") + p.count("?") / 2) / len(p) * 100
            yield [t for p in pieces for t in memo[p]], capitals / letters if letters else 0.0, marks


TOKENS = "words array<bigint>, sizes array<int>, capitals array<float>, marks array<float>, disguised array<int>, odd_at array<int>, odd array<string>"


def _lists(values: list, offsets: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _parse(keys: list[str], strings: bool):
    """Batches (keys, text) to (keys, TOKENS[, strings]): sizes, capitals, marks and disguised per passage,
    odd_at and odd the words that the lexicon has to look at and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for big in batches:
            for at in range(0, big.num_rows, 2_000):
                b = big.slice(at, 2_000)
                words, sizes, capitals, marks, disguised, odd_at, odd, plain = ([] for _ in range(8))
                ends: list[list[int]] = [[0], [0], [0]]  # of words, passages, odd words
                for text in b.column("text").to_pylist():
                    first = len(words)
                    for tokens, c, m in reader.passages(text):
                        start = len(words)
                        words += [t[0] for t in tokens]
                        sizes.append(len(tokens))
                        capitals.append(c)
                        marks.append(m)
                        disguised.append(sum([t[1] for t in tokens]))
                        if strings:
                            plain += [t[3] for t in tokens]
                        if disguised[-1] or any([t[2] for t in tokens]):
                            for i, t in enumerate(tokens, start - first):
                                if t[2] is not None:
                                    odd_at.append(i)
                                    odd.append(t[2])
                    for e, v in zip(ends, (words, sizes, odd)):
                        e.append(len(v))
                out = [b.column(k) for k in keys] + [
                    _lists(words, ends[0], pa.int64()), _lists(sizes, ends[1], pa.int32()), _lists(capitals, ends[1], pa.float32()),
                    _lists(marks, ends[1], pa.float32()), _lists(disguised, ends[1], pa.int32()), _lists(odd_at, ends[2], pa.int32()), _lists(odd, ends[2], pa.string()),
                ]
                names = [*keys, "words", "sizes", "capitals", "marks", "disguised", "odd_at", "odd"]
                if strings:
                    out.append(_lists(plain, ends[0], pa.string()))
                    names.append("strings")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def parsed(rows: DataFrame, keys: list[str], strings: bool = False) -> DataFrame:
    """(keys, TOKENS[, strings]) of rows (keys, text)."""
    kinds = dict(rows.dtypes)
    kind = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + TOKENS + (", strings array<string>" if strings else "")
    return rows.select(*keys, "text").mapInArrow(_parse(keys, strings), kind)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def run_hash(words: list[str]) -> int:
    """The hash under which a run of one to three words is kept."""
    h = np.array([word_hash(w) for w in words], np.int64).view(np.uint64)
    out = h[:1]
    for k in range(1, len(h)):
        out = _mix(out, h[k : k + 1])
    return int(out.view(np.int64)[0])


class Lexicon:
    """Weights of runs of words by hash, one column for each fold left out and one for none.

    Starred words are looked up by their visible letters, words run together by the words in them;
    both among the words of some length that weigh something in any column.
    """

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray, words: list[str]) -> None:
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.weights = keys.view(np.uint64)[order], weights[order]
        self.words = words
        self._ready = False

    def _prepare(self) -> None:
        self.may = np.zeros(1 << self.BITS, bool)
        self.may[self.keys >> np.uint64(64 - self.BITS)] = True
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for w in self.words:
            self.by_shape.setdefault((len(w), w[0]), []).append(w)
        self.inside = {w for w in self.words if len(w) > 3} | {w for w in SECOND if len(w) > 2}
        self.longest = max(map(len, self.inside), default=0)
        self._ready = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of hashes in the lexicon, -1 for those that it lacks."""
        if not self._ready:
            self._prepare()
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.may[h >> np.uint64(64 - self.BITS)])
        if len(at):
            row = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[row] == h[at]
            out[at[hit]] = row[hit]
        return out

    def unstar(self, w: str) -> str:
        for known in self.by_shape.get((len(w), w[0]), ()):
            if all(a == b or a == "*" for a, b in zip(w, known)):
                return known
        return w

    def split(self, w: str) -> list[str]:
        """A word run together, cut at the words known; what is between them stays in pieces."""
        out, at, i = [], 0, 0
        while i < len(w):
            for n in range(min(self.longest, len(w) - i), 2, -1):
                if w[i : i + n] in self.inside:
                    out += [w[at:i]] * (at < i) + [w[i : i + n]]
                    at = i = i + n
                    break
            else:
                i += 1
        return out + [w[at:]] * (at < len(w))

    def plain(self, w: str) -> list[str]:
        if not self._ready:
            self._prepare()
        if "*" in w:
            return [self.unstar(w)]
        return [w] if w in self.inside else self.split(w)


class Batch:
    """The words of a batch of parsed documents, with the runs that each begins and their passages."""

    def __init__(self, b: pa.RecordBatch, lexicon: Lexicon | None = None) -> None:
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = b.column(name)
            ends = column.offsets.to_numpy()
            return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]

        words, word_ends = flat("words")
        self.sizes, ends = flat("sizes")
        self.sizes = self.sizes.astype(np.int64)
        self.capitals, self.marks, self.disguised = (flat(n)[0].astype(np.float64) for n in ("capitals", "marks", "disguised"))
        self.docs, self.passages = b.num_rows, len(self.sizes)
        self.doc = np.repeat(np.arange(self.docs), np.diff(ends))  # of each passage
        self.words = words.view(np.uint64)
        if lexicon is not None:
            self._undisguise(b, lexicon, word_ends)
        self.place = np.repeat(np.arange(self.passages), self.sizes)  # the passage of each word
        w = self.words
        n = len(w)
        same2 = self.place[1:] == self.place[:-1] if n > 1 else np.zeros(0, bool)
        same3 = self.place[2:] == self.place[:-2] if n > 2 else np.zeros(0, bool)
        two = _mix(w[:-1], w[1:]) if n > 1 else w[:0]
        #: By length of run: where it begins, and its hash.
        self.runs = [(np.arange(n), w), (np.flatnonzero(same2), two[same2]), (np.flatnonzero(same3), _mix(two[:-1], w[2:])[same3] if n > 2 else w[:0])]

    def _undisguise(self, b: pa.RecordBatch, lexicon: Lexicon, word_ends: np.ndarray) -> None:
        column = b.column("odd_at")
        if not len(column.flatten()):
            return
        first = np.cumsum(np.r_[0, self.sizes])  # of each passage, before anything moves
        pieces, at = [], 0
        words = self.words.copy()
        sizes = self.sizes.copy()
        for start, places, strings in zip(word_ends, column.to_pylist(), b.column("odd").to_pylist()):
            for place, s in zip(places, strings):
                i = int(start) + place
                new = lexicon.plain(s)
                if new == [s]:
                    continue
                h = np.array([word_hash(x) for x in new], np.int64).view(np.uint64)
                if len(h) == 1:
                    words[i] = h[0]
                else:
                    pieces += [words[at:i], h]
                    at = i + 1
                    sizes[np.searchsorted(first, i, "right") - 1] += len(h) - 1
        self.words = np.concatenate([*pieces, words[at:]]) if pieces else words
        self.sizes = sizes

    def weights(self, lexicon: Lexicon, column: np.ndarray) -> list[np.ndarray]:
        """By length of run, the weight of the run that begins at each word (0 for none), in the
        lexicon's column for the word's document."""
        out = []
        for at, h in self.runs:
            row = lexicon.find(h)
            hit = np.flatnonzero(row >= 0)
            x = np.zeros(len(self.words))
            x[at[hit]] = lexicon.weights[row[hit], column[self.doc[self.place[at[hit]]]]]
            out.append(x)
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per passage."""
        return np.bincount(self.place, weights=x, minlength=self.passages)


FEATURES = ["sum", "density", "top", "hits", "hit_share", "near", "capitals", "marks", "disguise", "next_sum", "disguises", "hit_passages", "length"]


def features(b: Batch, lexicon: Lexicon, column: np.ndarray) -> np.ndarray:
    """What FEATURES names, one row a document; ``column`` is the lexicon's column for each document."""
    x1, x2, x3 = b.weights(lexicon, column)
    sums = b.sums(x1 + x2 + x3)
    most = np.maximum(np.maximum(x1, x2), x3)
    strong = np.flatnonzero(most > 2)
    where = b.place[strong]
    hits = np.bincount(where, minlength=b.passages).astype(np.float64)
    top, near = np.zeros(b.passages), np.zeros(b.passages)
    np.maximum.at(top, where, most[strong])
    second = np.flatnonzero(np.isin(b.words, np.array([word_hash(w) for w in sorted(SECOND)], np.int64).view(np.uint64)))
    if len(second) and len(strong):
        at = np.searchsorted(second, strong)
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(second) - 1)):
            same = b.place[second[k]] == where
            np.maximum.at(near, where[same], 1.0 / (1.0 + np.abs(second[k] - strong)[same]))
    n = np.maximum(1, b.sizes)
    each = np.stack([sums, sums / n, top, hits, hits / n, near, b.capitals, b.marks, b.disguised / n], axis=1)
    out = np.zeros((b.docs, len(FEATURES)))
    if not b.passages:
        return out
    order = np.lexsort((np.arange(b.passages), -sums, b.doc))
    first = np.flatnonzero(np.r_[True, b.doc[order][1:] != b.doc[order][:-1]])
    docs = b.doc[order[first]]
    out[docs, :9] = each[order[first]]
    next_ = first + 1
    has = (next_ < len(order)) & np.isin(next_, first, invert=True)
    out[docs[has], 9] = sums[order[next_[has]]]
    out[:, 10] = np.bincount(b.doc, weights=b.disguised, minlength=b.docs)
    out[:, 11] = np.bincount(b.doc, weights=hits > 0, minlength=b.docs)
    out[:, 12] = np.log1p(np.bincount(b.doc, minlength=b.docs))
    return out


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, y): what most raters say; each rater has one voice, raters without a name share one."""
    said = labels.where("doc_id is not null and toxic in (0, 1)")
    said = said.groupBy("doc_id", "rater" if "rater" in said.columns else F.lit(0).alias("rater")).agg(F.avg("toxic").alias("a"))
    return said.groupBy("doc_id").agg(F.avg("a").alias("a")).where("a != 0.5").select("doc_id", (F.col("a") > 0.5).cast("int").alias("y"))


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, y, fold, TOKENS, strings) of at most ``most`` labelled documents, parsed where they are."""
    y = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # so this side is bounded
    rows = documents.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(y), "doc_id")
    tokens = parsed(rows.withColumn("h", F.xxhash64("text")), ["doc_id", "y", "h"], strings=True)
    inner = [c for c in tokens.columns if c not in ("doc_id", "h")]
    once = tokens.groupBy("doc_id").agg(F.min_by(F.struct(*inner), "h").alias("x"))
    return once.select("doc_id", "x.*", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def _entry_rows(shared):
    """(entry, fold, mask, n): in how many documents or passages runs occur, by the document's fold and
    by the lexicons (bits of the mask) for which they are positive.

    Without a lexicon a document's class is its runs' class. With one, of a positive document only the
    passages that carry its weight are positive, and passages are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value if shared else None
        for big in batches:
            for start in range(0, big.num_rows, 500):
                rb = big.slice(start, 500)
                b = Batch(rb)
                y, fold = rb.column("y").to_numpy(), rb.column("fold").to_numpy()
                if lexicon is None:
                    mask, unit = np.where(y > 0, (1 << FOLDS + 1) - 1, 0), b.doc
                    mask = mask[b.doc]
                else:
                    plain = Batch(rb, lexicon)
                    mask, unit = np.zeros(b.passages, np.int64), np.arange(b.passages)
                    for k in range(FOLDS + 1):
                        sums = plain.sums(sum(plain.weights(lexicon, np.full(b.docs, k))))
                        least = np.full(b.docs, 0.0)
                        np.maximum.at(least, b.doc, sums)
                        least = np.maximum(3.0, least / 2)
                        mask |= ((y[b.doc] > 0) & (sums >= least[b.doc])).astype(np.int64) << k
                entries, tags = [], []
                for at, h in b.runs:
                    place = b.place[at]
                    _, once = np.unique(_mix(h, unit[place].astype(np.uint64)), return_index=True)
                    entries.append(h[once])
                    tags.append(mask[place[once]] * FOLDS + fold[b.doc[place[once]]])
                h, tag = np.concatenate(entries), np.concatenate(tags)
                order = np.lexsort((tag, h))
                h, tag = h[order], tag[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])]) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(h)])
                h, tag = h[first], tag[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((tag % FOLDS).astype(np.int32)), pa.array((tag // FOLDS).astype(np.int32)), pa.array(n.astype(np.int64))],
                    ["entry", "fold", "mask", "n"],
                )

    return run


def _weights(sample: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-odds for each fold left out and for none) of the runs kept: those with an absolute
    weight over 1 in any column. Only they reach the driver; the sample bounds them."""
    spark = sample.sparkSession
    rows = sample.select("y", "fold", "words", "sizes", "capitals", "marks", "disguised", "odd_at", "odd").mapInArrow(_entry_rows(shared), "entry bigint, fold int, mask int, n bigint")
    own = [F.when((F.col("fold") != k) & (F.col("mask").bitwiseAND(1 << k) != 0), F.col("n")) for k in range(FOLDS + 1)]
    rest = [F.when((F.col("fold") != k) & (F.col("mask").bitwiseAND(1 << k) == 0), F.col("n")) for k in range(FOLDS + 1)]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"{x}{k}") for x, cs in (("a", own), ("b", rest)) for k, c in enumerate(cs)]
    counts = cut(rows.groupBy("entry").agg(*sums))
    if shared:  # a passage has some dozens of entries; their sums stand for the numbers of passages
        t = counts.agg(*[(F.sum(c) / 40).alias(c) for c in counts.columns[1:]]).first().asDict()
    else:
        folds = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
        t = {f"{x}{k}": float(sum(n for (f, y), n in folds.items() if f != k and y == v)) for x, v in (("a", 1), ("b", 0)) for k in range(FOLDS + 1)}
    columns = []
    for k in range(FOLDS + 1):
        p, q = max(1.0, t[f"a{k}"]), max(1.0, t[f"b{k}"])
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        odds = F.log((a + 0.5 * p / (p + q)) / (p + 0.5)) - F.log((b + 0.5 * q / (p + q)) / (q + 0.5))
        columns.append(F.when(a + b >= LEAST_DOCS, F.greatest(F.lit(-6.0), F.least(F.lit(6.0), odds))).alias(f"w{k}"))
    seeds = {run_hash([w]): w for w in SEED}
    names = [f"w{k}" for k in range(FOLDS + 1)]
    strong = F.lit(False)
    for c in names:
        strong = strong | F.coalesce(F.abs(c) > 1, F.lit(False))
    kept = counts.select("entry", *columns).where(strong | F.col("entry").isin(list(seeds))).toArrow()
    keys = kept["entry"].to_numpy()
    told = np.stack([kept[c].to_numpy(zero_copy_only=False) for c in names], axis=1).astype(np.float64).reshape(-1, FOLDS + 1)
    new = np.array([h for h in seeds if h not in set(keys.tolist())], np.int64)
    is_seed = np.r_[np.isin(keys, np.array(list(seeds), np.int64)), np.ones(len(new), bool)]
    keys, told = np.r_[keys, new], np.concatenate([told, np.full((len(new), FOLDS + 1), np.nan)])
    weights = np.where(np.abs(told) > 1, told, 0.0)
    weights[is_seed[:, None] & np.isnan(told)] = 3.0  # what the labels don't speak of
    return keys, weights


def _strings(sample: DataFrame, keys: np.ndarray, weights: np.ndarray) -> list[str]:
    """The single words among the entries that weigh more than 1 in any column."""
    spark = sample.sparkSession
    strong = spark.createDataFrame(pa.table({"h": keys[(weights > 1).any(axis=1)]}))
    words = sample.select(F.explode("strings").alias("w")).distinct().withColumn("h", F.xxhash64("w"))
    return sorted({r["w"] for r in words.join(F.broadcast(strong), "h", "left_semi").select("w").collect() if "*" not in r["w"]} | set(SEED))


def learned(sample: DataFrame) -> Lexicon:
    """The lexicon: a column without each fold, and one from all.

    First from documents; then from passages, positive being those that carry a positive document's
    weight, so that what merely stands beside abuse loses its weight.
    """
    shared = None
    for _ in range(ROUNDS + 1):
        keys, weights = _weights(sample, shared)
        out = Lexicon(keys, weights, _strings(sample, keys, weights))
        shared = sample.sparkSession.sparkContext.broadcast(out)
    return out


def _company_rows(shared):
    """(entry, kind, n): in how many passages a positive entry stands in abusive company, or not; for
    entry NULL, how many passages are abusive, or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for rb in batches:
            b = Batch(rb, lexicon)
            weights = b.weights(lexicon, np.full(b.docs, FOLDS))
            n = len(b.words)
            first, groups, hashes = [], [], []  # of each length: an entry's first occurrence in its passage
            for (at, h), x in zip(b.runs, weights):
                hit = x[at] != 0
                at, h = at[hit], h[hit]
                key, once, group = np.unique(_mix(h, b.place[at].astype(np.uint64)), return_index=True, return_inverse=True)
                own = np.zeros(n)
                own[at[once]] = x[at[once]]
                first.append(own)
                groups.append((at, group, len(key)))
                hashes.append((at[once], h[once], x[at[once]]))
            whole = b.sums(sum(first))
            p = int((whole >= COMPANY).sum())
            entries, kinds, counts = [[None, None]], [[1, 0]], [[p, b.passages - p]]
            up = [np.maximum(f, 0.0) for f in first]
            shift = lambda v, k: np.r_[np.zeros(k), v[:-k]] if n > k else np.zeros(n)
            # what holds the run that begins at a word: longer runs from there or from a word or two before
            held = [up[0] + up[1] + shift(up[1], 1) + up[2] + shift(up[2], 1) + shift(up[2], 2), up[1] + up[2] + shift(up[2], 1), up[2]]
            for (at, group, size), (once, h, x), inside in zip(groups, hashes, held):
                place = b.place[once]
                rest = whole[place] - np.bincount(group, weights=inside[at], minlength=size)
                told = (x > 0) & (b.sizes[place] >= TELLING)
                tag = (h[told] << np.uint64(1)) | (rest[told] >= COMPANY).astype(np.uint64)
                key, at_, count = np.unique(tag, return_index=True, return_counts=True)
                entries.append(h[told][at_].view(np.int64).tolist())
                kinds.append((key & np.uint64(1)).astype(np.int64).tolist())
                counts.append(count.tolist())
            flat = lambda v: [x for part in v for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(flat(entries), pa.int64()), pa.array(flat(kinds), pa.int32()), pa.array(flat(counts), pa.int64())], ["entry", "kind", "n"])

    return run


def sobered(tokens: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon as the whole corpus bears it out: an entry that mostly stands in harmless passages, by
    the rest of what is in them, gets the weight of that share. Weights don't fall below 0 by it."""
    shared = tokens.sparkSession.sparkContext.broadcast(lexicon)
    rows = tokens.mapInArrow(_company_rows(shared), "entry bigint, kind int, n bigint").groupBy("entry", "kind").agg(F.sum("n").alias("n")).toArrow()  # two rows an entry at most
    n = {(e, k): x for e, k, x in zip(*(rows[c].to_pylist() for c in ("entry", "kind", "n")))}
    p, q = n.get((None, 1), 0) + 1, n.get((None, 0), 0) + 1
    weights = lexicon.weights.copy()
    for i, e in enumerate(lexicon.keys.view(np.int64).tolist()):
        a, b = n.get((e, 1), 0), n.get((e, 0), 0)
        w = weights[i, FOLDS]
        if w > 0:
            if a + b >= 2 * LEAST_DOCS:
                share = math.log((a + 1) / (p + 1)) - math.log((b + 1) / (q + 1)) - math.log(q / p) / 2
                w = max(0.0, min(w, share))
            weights[i] = np.where(weights[i] > 0, np.minimum(weights[i], w), weights[i])
            weights[i, FOLDS] = w
    return Lexicon(lexicon.keys.view(np.int64), weights, lexicon.words)


def _featurise(shared, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lexicon = shared.value
            column = rb.column("fold").to_numpy() if "fold" in extra else np.full(rb.num_rows, FOLDS)
            f = features(Batch(rb, lexicon), lexicon, column)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(len(FEATURES))), *(rb.column(c) for c in extra)], [*FEATURES, *extra])

    return run


_KIND = ", ".join(f"{f} double" for f in FEATURES)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every document (doc_id, text, source)."""
    spark = documents.sparkSession
    sample = cut(labelled(documents, labels))
    classes = {r["y"] for r in sample.select("y").distinct().collect()}
    rows = documents.where("doc_id is not null").select("doc_id", "source", "text")
    if classes != {0, 1}:
        return rows.groupBy("doc_id").agg(F.min("source").alias("source")).withColumn("score", F.lit(None).cast("double"))
    at = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    parsed(rows, ["doc_id", "source"]).write.parquet(at)
    tokens = spark.read.parquet(at)
    shared = spark.sparkContext.broadcast(sobered(tokens, learned(sample)))

    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = sample.mapInArrow(_featurise(shared, ["doc_id", "y", "fold"]), f"{_KIND}, doc_id bigint, y int, fold int")
    train = cut(vector.transform(train.repartition(1).sortWithinPartitions("doc_id")).select("features", F.col("y").cast("double").alias("y"), "fold"))
    raw = vector_to_array("rawPrediction")[1].alias("raw")

    def fit(rows_: DataFrame):
        return GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, stepSize=0.2, seed=7).fit(rows_)

    halves = [train.where(F.col("fold") % 2 == k) for k in (0, 1)]
    if all(h.select("y").distinct().count() == 2 for h in halves):
        calibration = fit(halves[0]).transform(halves[1]).select(raw, "y").unionByName(fit(halves[1]).transform(halves[0]).select(raw, "y"))
        trees = fit(train)
    else:  # too few labelled documents to hold any back
        trees = fit(train)
        calibration = trees.transform(train).select(raw, "y")
    isotonic = IsotonicRegression(labelCol="y", featuresCol="raw").fit(calibration)
    # repeated documents meet after scoring, so no text is moved
    found_ = tokens.mapInArrow(_featurise(shared, ["doc_id", "source"]), f"{_KIND}, doc_id bigint, source string")
    predicted = isotonic.transform(trees.transform(vector.transform(found_)).select("doc_id", "source", raw))
    return predicted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("prediction").alias("score"))


def found(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.where(F.col("score") >= threshold).select("doc_id")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, reported, rate, mean_score)."""
    hit = (F.col("score") >= threshold).cast("int")
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(hit), F.lit(0)).alias("reported"),
        F.round(F.avg(hit), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def scores_of(spark, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
