"""Visually identical text with different characters: one form for all of it.

Two tables are compiled once per process from Unicode's own decompositions and a list of look-alike
letters, and checked for conflicts: what each code point shows, taken apart into letters and marks, and
the steps of a transducer whose states are composed characters: (state, mark) to the next state. Texts
are then read in one pass, cluster by cluster (a character and the marks and invisible characters after
it, always the longest), and every cluster takes its letter and as many steps as its marks allow;
clusters met once are kept. Nothing is normalised while texts are read, but Hangul, whose syllables are
a rule and no table.

What counts as the same: widths (full, half), letter styles of the mathematical alphabets, joined
letters, Roman numeral signs, every kind of blank of one character, letters of other alphabets that
look like Latin ones, composed and decomposed accents, invisible characters, and the kinds of line
end. Case, accents, punctuation, tabs, line breaks and the number of blanks stay different.
Superscripts, fractions, circled signs and long s show differently and stay. A joiner stays where
it shows: between pictographs, and in scripts whose letters it joins.

Cases: NULL gives NULL, an empty text an empty text, a text of invisible characters an empty text.
Only rows with a character outside printable ASCII and Latin-1 reach Python; others pass in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Plain character -> characters of other alphabets that a reader takes for it.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲᴄⅽⲥꮯ", "d": "ԁⅾ", "e": "еҽꬲ", "g": "ɡց", "h": "һհ", "i": "іιⅰꭵ",
    "j": "јϳ", "l": "ӏⅼ", "m": "ⅿ", "n": "ոռ", "o": "оοօᴏⲟꬽ", "p": "рρⲣ", "q": "ԛզ", "r": "ꭇꭈⲅꮁ", "s": "ѕꜱꮪ",
    "u": "սυᴜꭎꭒ", "v": "ѵνᴠⅴꮩ", "w": "ԝᴡꮃ", "x": "хⅹ", "y": "уγүꭚ", "z": "ᴢꮓ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟⅭꓚⲤ", "D": "ᎠⅮꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ",
    "I": "ІΙӀⅠꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "ᏞⅬꓡ", "M": "МΜᎷⅯꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ",
    "Q": "Ԛ", "R": "ᏒꓣᎡ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙⅤꓦ", "W": "ԜᎳꓪ", "X": "ХΧⅩꓫⲬ", "Y": "ҮΥꓬⲨ", "Z": "ΖᏃꓜ",
    "-": "‐‑−", ":": "։꞉", ";": "\u037e", ",": "‚ꓹ", ".": "․ꓸ",
    "/": "⁄∕", "*": "∗", "|": "∣", "~": "∼",
}

#: Ranges whose characters are looked up in Unicode's decompositions.
_RANGES = ((0xA0, 0x250), (0x2000, 0x2070), (0x2100, 0x2190), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x1D400, 0x1D800))
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>"}
#: Of decompositions tagged <compat>: digraphs, blanks, dots, Roman numerals, ligatures, the micro sign.
_COMPAT = ((0xB5, 0xB6), (0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4), (0x2000, 0x2027), (0x205F, 0x2060), (0x2160, 0x2180), (0xFB00, 0xFB07))

_CONTROLS = "\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
_INVISIBLE = (
    "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_MARKS = "\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u093c\u094d\u11a8-\u11ff\u1161-\u11a7\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\u3099\u309a\ufe20-\ufe2f"
_PICT = "\xa9\xae\u203c-\u2bff\U0001f000-\U0001faff"
_JOINED = re.compile("[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af]")
_HANGUL = re.compile("[\u1100-\u11ff\uac00-\ud7a3]")
#: Characters that are already what they show, unless a mark follows.
_INERT = "\xa1-\xac\xae-\xb4\xb6-\xff"
#: A text without such a character is its own form (Java and Python read it alike).
NEEDS_FORM = "[^\\t\\n\\x20-\\x7e\\xa1-\\xac\\xae-\\xb4\\xb6-\\xff]"


class ConflictError(ValueError):
    """A character has two outputs, or an output is changed again."""


def compile_table(lookalikes: dict[str, str] = LOOKALIKES) -> dict[int, str]:
    """Code point -> what it shows; raises ConflictError if the mapping isn't one."""
    table: dict[int, str] = {}
    for plain, others in lookalikes.items():
        for ch in others:
            if ch.isascii() or table.get(ord(ch), plain) != plain:
                raise ConflictError(f"U+{ord(ch):04X} can't show as {plain!r}")
            table[ord(ch)] = plain
    for low, high in _RANGES:
        for cp in range(low, high):
            ch = chr(cp)
            if cp in table:
                continue
            if unicodedata.category(ch) == "Zs" and cp != 0x1680:
                table[cp] = " "
                continue
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            if tag in _SAME_LOOK or tag == "<compat>" and any(a <= cp < b for a, b in _COMPAT):
                table[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    for cp, out in list(table.items()):  # an output may have outputs of its own
        for _ in range(4):
            again = "".join(table.get(ord(c), c) for c in unicodedata.normalize("NFD", out))
            if again == out:
                break
            out = again
        else:
            raise ConflictError(f"U+{cp:04X} has no last output")
        table[cp] = out
    return table


def compile_steps(table: dict[int, str]) -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """(parts, steps): characters as the letters and marks that they show, and for a composed character
    followed by a mark the character that both make. Raises ConflictError if a pair makes two."""
    parts: dict[str, tuple[str, ...]] = {}
    steps: dict[str, str] = {}
    for cp in (*range(0x80, 0xAC00), *range(0xF900, 0x30000)):
        ch = chr(cp)
        rest = unicodedata.decomposition(ch)
        if not rest and cp not in table:
            continue
        apart = unicodedata.normalize("NFD", ch)
        shown = "".join(unicodedata.normalize("NFD", table.get(ord(c), c)) for c in apart)
        if shown != ch:
            parts[ch] = tuple(shown)
        if rest and rest[0] != "<" and " " in rest:
            pair = "".join(chr(int(x, 16)) for x in rest.split())
            if unicodedata.normalize("NFC", pair) == ch:  # but what Unicode never composes
                if steps.setdefault(pair, ch) != ch:
                    raise ConflictError(f"{pair!r} makes two characters")
    return parts, steps


class Transducer:
    """The compiled mapping; ``apply`` brings a text to its form in one pass."""

    MEMO = 200_000  # clusters kept per process; beyond it they are computed again

    def __init__(self) -> None:
        self.table = compile_table()
        self.parts, self.steps = compile_steps(self.table)
        ext = f"[{_CONTROLS}{_INVISIBLE}{_MARKS}]"
        self.strip = re.compile(f"[{_CONTROLS}{_INVISIBLE}]")
        self.strip_joined = re.compile(f"[{_CONTROLS}{_INVISIBLE}]".replace("\u200b-\u200f", "\u200b\u200e\u200f"))
        pict = f"[{_PICT}]{ext.replace(chr(0x200B) + '-' + chr(0x200F), chr(0x200B) + chr(0x200C) + chr(0x200E) + chr(0x200F))}*[\U0001f3fb-\U0001f3ff]?"
        # emoji joined by U+200D | line ends | a cluster that may change
        self.pattern = re.compile(
            f"(?P<joined>{pict}(?:\u200d\ufe0f?{pict})+)|\r\n?|[\x85\u2028\u2029]"
            f"|[\x00-\x7f{_INERT}]{ext}+|[^\x00-\x7f{_INERT}]{ext}*|[{_CONTROLS}]"
        )
        self.memo: dict[str, str] = {"\r\n": "\n", "\r": "\n", "\x85": "\n", "\u2028": "\n", "\u2029": "\n"}

    def cluster(self, s: str) -> str:
        if s[0] == "\U0001f3f4":  # flags are spelled with tags
            return s
        strip = self.strip_joined if _JOINED.match(s) else self.strip
        s = strip.sub("", s)
        if _HANGUL.search(s):
            return unicodedata.normalize("NFC", s)
        chars: list[str] = []
        for c in s:
            chars += self.parts.get(c, c)
        rank = unicodedata.combining
        if len(chars) > 2:  # marks in their order, each run of them by itself
            at = 0
            for i in range(1, len(chars) + 1):
                if i == len(chars) or not rank(chars[i]):
                    chars[at + 1 : i] = sorted(chars[at + 1 : i], key=rank)
                    at = i
        out: list[str] = []
        letter, last = -1, 0  # where the state is; the rank of the last mark that was passed over
        for c in chars:
            r = rank(c)
            if letter >= 0 and (len(out) == letter + 1 or last < r) and (to := self.steps.get(out[letter] + c)):
                out[letter] = to
                continue
            if not r:
                letter = len(out)
            last = r
            out.append(c)
        return "".join(out)

    def _replace(self, m: re.Match[str]) -> str:
        s = m.group()
        out = self.memo.get(s)
        if out is None:
            if m.lastgroup == "joined":
                out = "\u200d".join(self.strip.sub("", part) for part in s.split("\u200d"))
            else:
                out = self.cluster(s)
            if len(self.memo) < self.MEMO:
                self.memo[s] = out
        return out

    def apply(self, text: str) -> str:
        return self.pattern.sub(self._replace, text)

    def fold(self, text: str) -> str:
        """The form in lower case; capitals of look-alikes that only look alike when small count too."""
        return self.apply(self.apply(text).lower())


_shared: Transducer | None = None


def transducer() -> Transducer:
    """This process's transducer, compiled at first use."""
    global _shared
    if _shared is None:
        _shared = Transducer()
    return _shared


def _batch(name: str):
    def run(texts: pa.Array) -> pa.Array:
        f = getattr(transducer(), name)
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return arrow_udf(run, "string")


def _gated(text: Column, method: str, plain: Column) -> Column:
    # Rows that need nothing send NULL to Python.
    return F.coalesce(_batch(method)(F.when(text.rlike(NEEDS_FORM), text)), plain)


def form(text: Column) -> Column:
    """The problem-1 form of a text column."""
    return _gated(text, "apply", text)


def folded(text: Column) -> Column:
    """The problem-1 form in lower case."""
    return _gated(text, "fold", F.lower(text))


def words_of(fold: Column) -> Column:
    """Runs of letters and digits of a folded text, as an array; none for NULL or ''."""
    return F.filter(F.split(fold, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def letters_of(fold: Column) -> Column:
    """Only the letters and digits of a folded text."""
    return F.regexp_replace(fold, "[^\\p{L}\\p{N}]+", "")


def key128(text: Column, salt: str = "") -> Column:
    """Two 64-bit hashes: equal for equal texts, and 128 bits keep billions of texts apart."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("palimpsest" + salt), text).alias("h2"))
