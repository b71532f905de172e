"""S0: canonical text. Built-in expressions for everything Spark has; NFKC and the decoders, which it
lacks, run in Arrow batches on the rows that need them only (others send NULL)."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.functions import fixed

INVISIBLE = "[\\p{Cf}\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]"
#: Blanks other than a line break, spelled out so that every regex dialect agrees.
BLANKS = "[ \\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2,}"
#: What may need the slow path: characters beyond ASCII, or a run long enough to be encoded.
SLOW = "[^\\x00-\\x7f]|[A-Za-z0-9+/]{16}|%[0-9A-Fa-f]{2}"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, fixed.HOMOGLYPHS_FROM, fixed.HOMOGLYPHS_TO)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLANKS, " "), "\\n{3,}", "\n\n")


def fast_form(text: Column) -> Column:
    """Invisible characters, look-alikes and blanks: the built-in part of the canonical text."""
    return collapse_blanks(fold_homoglyphs(strip_invisible(text)))


def needs_slow_path(text: Column) -> Column:
    return text.rlike(SLOW)


_DROP = re.compile(f"[{fixed.ZERO_WIDTH}]")
_TABLE = str.maketrans(fixed.HOMOGLYPHS_FROM, fixed.HOMOGLYPHS_TO)
_B64, _URL = re.compile(fixed.BASE64_BLOCK), re.compile(fixed.PERCENT_BLOCK)
_BLANKS, _LINES = re.compile(fixed.BLANK_RUN), re.compile(fixed.LINE_RUN)


def _readable(text: str) -> bool:
    good = sum(c in "\n\t" or c.isprintable() for c in text)
    return bool(text.strip()) and good >= fixed.PRINTABLE_SHARE * len(text)


def _from_percent(block: str) -> str | None:
    if "%" not in block:
        return None
    try:
        return unquote_to_bytes(block).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _from_base64(block: str) -> str | None:
    """The text of a block padded as it stands; one with too many padding signs is none."""
    try:
        return base64.b64decode(block + "=" * (-len(block) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None


def _decode(text: str, pattern: re.Pattern[str], decoder) -> tuple[str, bool]:
    hit = False

    def replace(m: re.Match[str]) -> str:
        nonlocal hit
        out = decoder(m.group())
        if out is None or out == m.group() or not _readable(out):
            return m.group()
        hit = True
        return out

    return pattern.sub(replace, text), hit


def canonical(text: str) -> tuple[str, bool, bool, bool]:
    """(text, had invisible, had look-alikes, had an encoded block), to a fixed point of few passes.

    The last pass's decoded text is returned as it is, without another clean-up.
    """
    invisible = lookalike = encoded = False
    for _ in range(fixed.DECODE_PASSES):
        text = unicodedata.normalize("NFKC", text)
        kept = _DROP.sub("", "".join(c for c in text if c in "\n\t" or unicodedata.category(c) not in ("Cf", "Cc")))
        invisible |= kept != text
        text = kept.translate(_TABLE)
        lookalike |= text != kept
        text = _LINES.sub("\n\n", _BLANKS.sub(" ", text))
        text, percent = _decode(text, _URL, _from_percent)
        text, b64 = _decode(text, _B64, _from_base64)
        if not (percent or b64):
            break
        encoded = True
    return text, invisible, lookalike, encoded


_KIND = pa.struct([("text", pa.string()), ("had_zero_width", pa.bool_()), ("had_homoglyph", pa.bool_()), ("had_encoded_block", pa.bool_())])


def _slow(texts: pa.Array) -> pa.Array:
    names = [f.name for f in _KIND]
    return pa.array([None if t is None else dict(zip(names, canonical(t))) for t in texts.to_pylist()], _KIND)


def canonicalize(text: Column) -> Column:
    """struct(text, had_zero_width, had_homoglyph, had_encoded_block); NULL for NULL."""
    slow = arrow_udf(_slow, "struct<text:string,had_zero_width:boolean,had_homoglyph:boolean,had_encoded_block:boolean>")(F.when(needs_slow_path(text), text))
    stripped = strip_invisible(text)
    quick = F.when(text.isNotNull(), F.struct(collapse_blanks(stripped).alias("text"), (stripped != text).alias("had_zero_width"), F.lit(False).alias("had_homoglyph"), F.lit(False).alias("had_encoded_block")))
    return F.coalesce(slow, quick)


def flags(canon: Column) -> Column:
    """The flags' names, comma-separated, in their order."""
    names = ("had_zero_width", "had_homoglyph", "had_encoded_block")
    return F.concat_ws(",", *[F.when(canon[n], F.lit(n)) for n in names])
