"""Chapter headings and tables of contents, across scripts.

A heading dialect is a rule: a pattern whose first group is the number and whose second is the
rest of the line, a numeral system, and whether the rest must look like a heading's. The first rule
that matches with a number from 1 to 999 names the line. Chapters are told apart by (rule, number),
so a heading listed in a table of contents and the chapter itself are one.

A document is worked on inside its row, as an array of lines: there is no shuffle, and documents
without any line that could be a heading are passed over by one look at their text. Known habits
kept on purpose: Roman numerals are read leniently, initials such as ``D. Smith`` count, a Han or
Thai heading is not checked for prose behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numerals import HAN, ROMAN, parse_arabic, parse_han, parse_roman, parse_thai
from lectern.functions.text import BLANK, let, split_lines, strip, strip_chars

_S, _WIDE, _R = f"[{BLANK}]", r"\x{ff10}-\x{ff19}", "".join(ROMAN)
CHAPTER_WORDS = ("hoofdstuk", "kapitel", "chapitre", "chapter", "capitolo", "cap[ií]tulo", r"ch\.?")
THAI_WORDS = ("บทที่", "ตอนที่", "ภาคที่", "ตอน", "ภาค", "บท")
TOC_WORDS = tuple("contents|index|table of contents|inhaltsverzeichnis|inhalt|sommaire|sumário|índice|indice|目次|目录|目錄|목차|차례|สารบัญ".split("|"))
PLAUSIBLE = rf"\A(?:{_S}*\z|{_S}*[.:)–—-]|{_S}+[\"“'(0-9A-ZÀ-Þ])"
TITLE_EDGES = r" \t.:–—-"


def latin_number(token: Column) -> Column:
    plain = parse_arabic(token)
    return F.coalesce(F.when(plain != 0, plain), parse_roman(token))


class Dialect(NamedTuple):
    name: str
    pattern: str  # groups: number, rest
    parse: Callable[[Column], Column]
    checked: bool = False  # the rest must look like a heading's


RULES: tuple[Dialect, ...] = (
    Dialect("latin-chapter", rf"(?iu)\A{_S}*(?:{'|'.join(CHAPTER_WORDS)}){_S}*([{_R}]{{1,7}}|[0-9]{{1,3}})(?U:\b)(.*)\z", latin_number, True),
    Dialect("roman-standalone", rf"\A{_S}*([{_R}]{{1,7}}){_S}*[:.]{_S}+([(“\"A-ZÀ-Þ].*)\z", parse_roman),
    Dialect("cjk-chapter", rf"\A{_S}*第{_S}*([{_WIDE}0-9{HAN}]+){_S}*[章节節回卷篇讲講部](.*)\z", parse_han),
    Dialect("cjk-markdown", rf"\A#{{1,6}}{_S}+第?{_S}*([{_WIDE}{HAN}]+){_S}*[章节節回卷篇讲講·、：:.](.*)\z", parse_han),
    Dialect("thai-chapter", rf"\A{_S}*(?:#{{1,6}}{_S}+)?(?:{'|'.join(THAI_WORDS)}){_S}*([๐-๙0-9]+)(.*)\z", parse_thai),
)
#: The same, but a Roman numeral stands apart from the chapter word, by a blank or a dot: ``Ch. VI`` is a chapter, the word ``Chvi`` isn't.
STRICT_RULES = (RULES[0]._replace(pattern=RULES[0].pattern.replace(f"([{_R}]{{1,7}}|", f"((?<=[{BLANK}.])[{_R}]{{1,7}}|")), *RULES[1:])
MAYBE = rf"(?iu)(?:\A|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]){_S}*(?:#{{1,6}}{_S}+)?(?:{'|'.join(CHAPTER_WORDS + THAI_WORDS)}|第|[{_WIDE}{HAN}]|[{_R}]{{1,7}}{_S}*[:.])"
MAYBE_LINE = rf"(?iu)\A{_S}*(?:#{{1,6}}{_S}+)?(?:{'|'.join(CHAPTER_WORDS + THAI_WORDS)}|第|[{_WIDE}{HAN}]|[{_R}]{{1,7}}{_S}*[:.])"
HEADING = "struct<number:int,title:string,rule:string>"


def is_toc(line: Column) -> Column:
    bare = strip(strip_chars(strip(line), "#"))
    return strip_chars(F.lower(bare), ":：", left=False).isin(*TOC_WORDS)


def match_line(line: Column, strict: bool = False) -> Column:
    """struct(number, title, rule) of the first rule that fits, or null."""
    found = F.lit(None).cast(HEADING)
    for rule in reversed(STRICT_RULES if strict else RULES):
        number, tail = rule.parse(F.regexp_extract(line, rule.pattern, 1)), F.regexp_extract(line, rule.pattern, 2)
        fits = line.rlike(rule.pattern)
        if rule.checked:
            fits = fits & tail.rlike(PLAUSIBLE)
        fits = fits & number.between(1, 999)
        hit = F.struct(number.alias("number"), strip_chars(tail, TITLE_EDGES).alias("title"), F.lit(rule.name).alias("rule"))
        found = F.when(fits, hit).otherwise(found)
    return found


def headings_of(lines: Column, strict: bool = False) -> Column:
    """array<struct(rule, number, line, title)> of an array of lines: first occurrences, by line."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    maybe = F.filter(numbered, lambda x: x["text"].rlike(MAYBE_LINE) & ~is_toc(x["text"]))
    hits = F.filter(F.transform(maybe, lambda x: F.struct(x["line"].alias("line"), match_line(x["text"], strict).alias("h"))), lambda x: x["h"].isNotNull())
    flat = F.transform(hits, lambda x: F.struct(x["h"]["rule"].alias("rule"), x["h"]["number"].alias("number"), x["line"].alias("line"), x["h"]["title"].alias("title")))
    first = let(F.array_sort(flat), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["rule"] != s[i - 1]["rule"]) | (x["number"] != s[i - 1]["number"])))
    by_line = F.array_sort(F.transform(first, lambda x: F.struct(x["line"].alias("line"), x["rule"].alias("rule"), x["number"].alias("number"), x["title"].alias("title"))))
    return by_line


EMPTY = "array<struct<line:int,rule:string,number:int,title:string>>"


def headings(text: Column, strict: bool = False) -> Column:
    return F.when(text.rlike(MAYBE), let(split_lines(text), lambda a: headings_of(a, strict))).otherwise(F.array().cast(EMPTY))


def has_toc(text: Column) -> Column:
    short = [w for w in TOC_WORDS if not any(o in w for o in TOC_WORDS if o != w)]  # who has a longer one has a short one
    held = let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in short]))
    return F.when(held, F.exists(split_lines(text), is_toc)).otherwise(F.lit(False))


def detect_structure(df: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """``df`` with headings (array), chapters (their number) and has_toc; a null text has none. ``strict`` wants Roman numerals apart from the chapter word."""
    value = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("headings", headings(value, strict)).withColumn("chapters", F.size("headings")).withColumn("has_toc", has_toc(value))


def heading_rows(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, rule, number, title): a row for each heading."""
    found = df.select(id_column, F.explode(headings(F.col(text))).alias("h"))
    return found.select(id_column, "h.line", "h.rule", "h.number", "h.title")


FALLBACK = rf"(?iu)\A{_S}*#*{_S}*(?:chapter{_S}+[0-9]+|第{_S}*[{_WIDE}0-9{HAN}]+{_S}*[章节節回])"


def fallback_probe(df: DataFrame, id_column: str = "doc_id", text: str = "text", first: int = 60) -> DataFrame:
    """(id, line, text): the first lines of each document that a permissive look takes for chapters; the cut is what the report is for."""
    numbered = F.transform(split_lines(F.coalesce(F.col(text), F.lit(""))), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    rows = df.select(id_column, F.explode(F.slice(F.filter(numbered, lambda x: x["text"].rlike(FALLBACK)), 1, first)).alias("x"))
    return rows.select(id_column, "x.line", F.col("x.text").alias(text))
