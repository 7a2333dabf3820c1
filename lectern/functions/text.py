"""Column expressions over text: script density, tokens, words, pages, lines and small string helpers.

All of them are built-in Spark expressions, so they stay in the JVM. Character classes are spelled
out because the regex engines at hand disagree about what a blank is. A null text gives null.
"""

from __future__ import annotations

from unicodedata import is_normalized, normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DENSE_RANGES = (
    (0x0E00, 0x0E7F), (0x2E80, 0x2EFF), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2A6DF),
)
DENSE = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in DENSE_RANGES)
#: Blanks as Unicode and the C separators have them, without and with line breaks.
INLINE = r"\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANK = INLINE + BREAKS
BLANK_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = rf"\r\n|[{BREAKS}]"
PER_DENSE, PER_OTHER, CHARS_PER_PAGE = 1.5, 4.0, 1800


def let(value: Column, body) -> Column:
    """``body(v)`` where v is computed once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def count_dense(text: Column) -> Column:
    """Characters of dense scripts; text of single-byte characters needs no look, and of others only what lies beyond the alphabets does."""
    beyond = F.regexp_replace(text, rf"[\x00-\x{{{DENSE_RANGES[0][0] - 1:x}}}]++", "")
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.regexp_count(beyond, F.lit(f"[{DENSE}]")))


def estimate_tokens(text: Column) -> Column:
    return let(count_dense(text), lambda dense: (dense / F.lit(PER_DENSE) + (F.length(text) - dense) / F.lit(PER_OTHER)).cast("int"))


def count_words(text: Column) -> Column:
    """Dense characters plus the blank-separated tokens with any other character."""
    plain = F.regexp_count(text, F.lit(rf"[^{BLANK}]++"))
    mixed = F.regexp_count(text, F.lit(rf"[^{BLANK}]*?[^{BLANK}{DENSE}][^{BLANK}]*"))
    return let(count_dense(text), lambda dense: F.when(dense == 0, plain).otherwise(dense + mixed))


def page_estimate(chars: Column, pages: Column | None = None) -> Column:
    guess = F.greatest(F.lit(1), F.bround(chars / F.lit(float(CHARS_PER_PAGE))).cast("int"))
    return guess if pages is None else F.coalesce(pages, guess)


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A-{3}\n.*?\n-{3}\n", "")


def strip(text: Column) -> Column:
    """Without blanks at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def strip_chars(text: Column, chars: str, left: bool = True, right: bool = True) -> Column:
    """Without the characters of ``chars`` (a regex class body) at the ends."""
    ends = [rf"\A[{chars}]+"] * left + [rf"[{chars}]+\z"] * right
    return F.regexp_replace(text, "|".join(ends), "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; what follows the last line end is a line only if it isn't empty."""
    return let(F.split(text, LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def file_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(file_name(path))


def excerpt(line: Column, limit: int = 120) -> Column:
    bare = strip(line)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.left(bare, F.lit(limit - 1)), F.lit("…")))


def link_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:]*)", 1))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and text without case: an array of (text, number)."""
    pieces = F.split(F.regexp_replace(text, r"([0-9]+)", "\u0001$1\u0001"), "\u0001")
    return F.transform(pieces, lambda x, i: F.struct(F.when(i % 2 == 0, F.lower(x)).otherwise("").alias("text"), F.when(i % 2 == 1, x.try_cast("decimal(38,0)")).alias("number")))


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition; batches and texts that are composed already pass as they are."""
    if pc.all(pc.string_is_ascii(text)).as_py() is not False:
        return text
    return pa.array([x if x is None or is_normalized("NFC", x) else normalize("NFC", x) for x in text.to_pylist()], pa.string())
