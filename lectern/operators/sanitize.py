"""Normalisation of extracted text, and protection of the corpus' source separators.

Order matters: canonical composition, line ends, invisible characters, control characters, runs of
blanks, blanks at line ends, runs of empty lines, forged separators, blanks at both ends.
Everything but the composition is one chain of built-in expressions. A null text stays null, an
empty one stays empty, and any other ends in one line break.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import INLINE, let, nfc, strip

RULE, MARKER = "=" * 80, "SOURCE: "
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
CONTROL = r"[\x00-\x1f\x7f&&[^\t\n\r]]"


def _where(text: Column, may: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """The replacement, where a cheap look says that there may be something to replace."""
    return let(text, lambda t: F.when(may(t), F.regexp_replace(t, pattern, by)).otherwise(t))


def _wide(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def neutralise_fences(text: Column) -> Column:
    """Lines that look like a source separator are marked: quoted, or ruled with dashes. Line ends become \\n."""
    text = _where(text, _wide, r"[\x{85}\x{2028}\x{2029}]", "\n")
    text = _where(text, lambda t: F.contains(t, F.lit(MARKER)), rf"(?dm)^(?={MARKER})", "[quoted] ")
    return _where(text, lambda t: F.contains(t, F.lit(RULE)), rf"(?dm)^([{INLINE}]*)={{80}}([{INLINE}]*)$", f"$1{'-' * 80}$2")


def normalise(text: Column) -> Column:
    """All steps but the canonical composition."""
    def has(*pieces: str) -> Callable[[Column], Column]:
        return lambda t: reduce(or_, [F.contains(t, F.lit(x)) for x in pieces])

    text = _where(text, has("\r"), r"\r\n?", "\n")
    text = _where(text, _wide, INVISIBLE, "")
    text = F.regexp_replace(text, CONTROL, "")
    text = _where(text, has("   ", "\t"), r"[ \t]{3,}", "  ")
    text = _where(text, lambda t: has(" \n", "\t\n")(t) | F.endswith(t, F.lit(" ")) | F.endswith(t, F.lit("\t")), r"(?dm)[ \t]+$", "")
    text = _where(text, has("\n\n\n\n"), r"\n{4,}", "\n\n\n")
    return F.concat(strip(neutralise_fences(text)), F.lit("\n"))


def sanitize(text: Column) -> Column:
    return F.when(text == "", "").otherwise(normalise(nfc(text)))


def sanitized(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, sanitize(F.col(column)))
