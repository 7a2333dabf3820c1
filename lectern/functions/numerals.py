"""Numeral systems as column expressions: each gives an integer, or null where the token isn't one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS, THAI_DIGITS = "".join(chr(0xFF10 + d) for d in range(10)), "".join(chr(0x0E50 + d) for d in range(10))
HAN_DIGITS, HAN_VALUES = "零〇一二三四五六七八九两", "001234567892"
HAN_UNITS = dict(zip("十百千", (10, 100, 1000), strict=True))
HAN = HAN_DIGITS + "".join(HAN_UNITS)
ROMAN = dict(zip("MDCLXVI", (1000, 500, 100, 50, 10, 5, 1), strict=True))


def _choose(char: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(char == k, F.lit(v)).otherwise(out)
    return out


def _chars(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def parse_arabic(token: Column) -> Column:
    return F.translate(token, WIDE_DIGITS, "0123456789").try_cast("int")


def parse_thai(token: Column) -> Column:
    return parse_arabic(F.translate(token, THAI_DIGITS, "0123456789"))


def parse_roman(token: Column) -> Column:
    """From the right: a sign smaller than one already seen is taken off. Order isn't checked, 0 is null."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(acc: Column, char: Column) -> Column:
        v = _choose(char, ROMAN)
        return F.struct((acc["total"] + F.when(v < acc["top"], -v).otherwise(v)).alias("total"), F.greatest(acc["top"], v).alias("top"))

    value = F.aggregate(F.reverse(_chars(F.upper(token))), start, step, lambda acc: acc["total"])
    return F.when(F.upper(token).rlike(rf"\A[{''.join(ROMAN)}]+\z") & (value != 0), value)


def parse_han(token: Column) -> Column:
    """Digits times units; a digit run without units counts by its last digit; plain digits are read as such."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, char: Column) -> Column:
        unit = _choose(char, HAN_UNITS)
        digit = F.translate(char, HAN_DIGITS, HAN_VALUES).try_cast("int")
        return F.struct(
            F.when(unit.isNull(), acc["sum"]).otherwise(acc["sum"] + F.coalesce(acc["last"], F.lit(1)) * unit).alias("sum"),
            F.when(unit.isNull(), digit).alias("last"),
        )

    value = F.aggregate(_chars(token), start, step, lambda acc: acc["sum"] + F.coalesce(acc["last"], F.lit(0)))
    return F.coalesce(parse_arabic(token), F.when(token.rlike(rf"\A[{HAN}]+\z") & (value != 0), value))
