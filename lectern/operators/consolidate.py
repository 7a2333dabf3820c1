"""Many files of one source become one document, in the order that the source itself declares.

Planning works on the names of files and the text of a few order files, so it stays on the driver,
as listing files does; a depth-first walk with a global visited set and a depth limit has no
relational form. A tree is a mapping from relative path to text (text may be None for files that
the plan needs no content of). Rendering is a DataFrame job.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_EXTENSIONS = tuple(".rst .md .markdown .Rmd .txt .ipynb".split())
MAX_DEPTH, EVERYTHING = 8, ("**/*",)
AUTO = "auto"
Names = tuple[str, ...]
Block = tuple[str | None, list[str]]
_ENTRY = re.compile(r"[^<>]*<\s*([^<>]+?)\s*>|(\w[\w/.-]*)")


def corpus_extensions() -> Names:
    from lectern.sources.files import FORMATS

    return tuple(dict.fromkeys([*PAGE_EXTENSIONS, *FORMATS]))


@dataclass
class Plan:
    """(rel, caption) of each part in reading order, relative to root, and the files that the order leaves out."""

    order: str
    root: str = ""
    parts: list[tuple[str, str | None]] = field(default_factory=list)
    unreached: list[str] = field(default_factory=list)


def natural_sort_key(text: str) -> list:
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", text)]


def parse_toctrees(text: str) -> list[Block]:
    """(caption, entries) of each toctree block: the indented lines below the directive that are no options."""
    out: list[Block] = []
    block: tuple[int, list] | None = None  # (indent of the directive, [caption, entries])
    for line in text.splitlines():
        indent = re.match(r"\s*", line).end()
        if block and line.strip():
            if indent > block[0]:
                if m := re.match(r"[ \t]+:caption:(.+)", line):
                    block[1][0] = m[1].strip()
                elif not re.match(r"\s*:[\w-]+:", line) and (m := _ENTRY.fullmatch(line.strip())):
                    block[1][1].append(m[1] or m[2])
                continue
            out.append((block[1][0], block[1][1]))
            block = None
        if not block and (m := re.match(r"([ \t]*)[.]{2}[ \t]+toctree::", line)):
            block = (len(m[1]), [None, []])
    if block:
        out.append((block[1][0], block[1][1]))
    return out


def resolve(entry: str, base: str, files: Mapping[str, str | None] | set[str], root: str = "") -> str | None:
    """The file that a declared entry means: beside the document or at the root, as named or with an extension."""
    name = entry.strip().lstrip("/")
    for folder in (base, root) if name else ():
        path = posixpath.normpath(posixpath.join(folder, name))
        stem = posixpath.splitext(path)[0] if posixpath.splitext(path)[1] else path
        for candidate in (path, *(stem + ext for ext in PAGE_EXTENSIONS)):
            if candidate in files:
                return candidate
    return None


def _unreached(files: Iterable[str], reached: set[str]) -> list[str]:
    wanted = {e.lower() for e in corpus_extensions()}
    return sorted((f for f in files if posixpath.splitext(f)[1].lower() in wanted and f not in reached), key=natural_sort_key)


def plan_sphinx(tree: Mapping[str, str | None], root_doc: str = "index.rst", max_depth: int = MAX_DEPTH) -> Plan:
    """Depth first through nested toctrees, each file once, the root document itself left out; paths are relative to its folder."""
    root = posixpath.dirname(root_doc)
    plan, seen = Plan("sphinx", root), {root_doc}

    def children(doc: str, caption: str | None) -> list[tuple[str, str | None]]:
        blocks = parse_toctrees(tree[doc] or "")
        found = [(resolve(e, posixpath.dirname(doc), tree, root), own or caption) for own, entries in blocks for e in entries]
        return [(c, cap) for c, cap in found if c]

    stack = [(c, cap, 1) for c, cap in reversed(children(root_doc, None))]
    while stack:
        doc, caption, depth = stack.pop()
        if depth > max_depth or doc in seen:
            continue
        seen.add(doc)
        plan.parts.append((doc, caption))
        stack += [(c, cap, depth + 1) for c, cap in reversed(children(doc, caption))]
    base = f"{root}/" if root else ""
    plan.unreached = [f.removeprefix(base) for f in _unreached([f for f in tree if f.startswith(base)], seen)]
    plan.parts = [(f.removeprefix(base), caption) for f, caption in plan.parts]
    return plan


def plan_jupyter_book(tree: Mapping[str, str | None], toc: str = "_toc.yml") -> Plan:
    """Line by line: ``root:``, ``- file:`` and ``caption:``, which holds until the next one."""
    plan, seen, caption = Plan("jupyter-book"), set(), None
    for line in (tree[toc] or "").splitlines():
        root = re.match(r"\s*root:\s*(\S+)", line)
        named = re.match(r"[ \t]*-[ \t]*file:\s*(\S+)", line)
        title = re.match(r"\s*(?:-\s*)?caption:\s*(.+?)\s*$", line)
        if not root and title and "file:" not in line:
            caption = title[1]
        elif root or named:
            rel = resolve((root or named)[1], "", tree)
            if rel and rel not in seen:
                seen.add(rel)
                plan.parts.append((rel, None if root else caption))
    plan.unreached = _unreached(tree, seen)
    return plan


def _glob(pattern: str) -> re.Pattern[str]:
    """Path pattern in which ** crosses folders and * does not."""
    out = [r"(?:[^/]+/)*" if p == "**" else translate(p)[:-2].replace(".*", "[^/]*").replace("(?s:", "(?:") + "/" for p in pattern.split("/")]
    return re.compile("".join(out).removesuffix("/") + r"\Z")


def plan_natural(tree: Iterable[str], include: Names = EVERYTHING, exclude: Names = ()) -> Plan:
    wanted, keep, drop = {e.lower() for e in corpus_extensions()}, [_glob(p) for p in include], [_glob(p) for p in exclude]
    found = {f for f in tree if posixpath.splitext(f)[1].lower() in wanted and any(p.match(f) for p in keep) and not any(p.match(f) for p in drop)}
    return Plan("natural", parts=[(f, None) for f in sorted(found, key=natural_sort_key)])


def detect_order(tree: Mapping[str, str | None]) -> str:
    if "_toc.yml" in tree:
        return "jupyter-book"
    return "sphinx" if any("toctree::" in (tree.get(d) or "") for d in ("index.rst", "docs/index.rst")) else "natural"


def build_plan(tree: Mapping[str, str | None], order: str = AUTO, include: Names = EVERYTHING, exclude: Names = ()) -> Plan:
    """The plan of the declared order; where the file that declares it is missing, natural order."""
    order = detect_order(tree) if order == AUTO else order
    if order == "jupyter-book" and "_toc.yml" in tree:
        return plan_jupyter_book(tree)
    if order == "sphinx":
        for doc in ("index.rst", "docs/index.rst"):
            if doc in tree:
                return plan_sphinx(tree, doc)
    return plan_natural(tree, include, exclude)


def plan_rows(spark: SparkSession, source: str, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(parts (source, seq, rel, caption), unreached (source, rel)) as tables."""
    parts = spark.createDataFrame([(source, i, rel, cap) for i, (rel, cap) in enumerate(plan.parts, 1)], "source string, seq int, rel string, caption string")
    return parts, spark.createDataFrame([(source, rel) for rel in plan.unreached], "source string, rel string")


def consolidated(parts: DataFrame, texts: DataFrame, title: str | None = None) -> DataFrame:
    """(source, text): the files (path, text) of plans (source, seq, rel, caption) as one document each; files a plan names and nobody has are empty."""
    rows = parts.join(texts.withColumnRenamed("path", "rel"), "rel", "left")
    return render(rows, ["source"], title=title)


def caption_changes(parts: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``parts`` with ``new_caption``: the caption where it differs from the last one before it, empty ones passed over."""
    caption = F.nullif(F.col("caption"), F.lit(""))
    before = F.last(caption, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("new_caption", F.when(caption.isNotNull() & ~caption.eqNullSafe(before), caption))


def carry_captions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with empty captions filled from the last one before them."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("caption", F.last(F.nullif(F.col("caption"), F.lit("")), ignorenulls=True).over(upto))


def render(parts: DataFrame, keys: list[str], order: str = "seq", title: str | None = None) -> DataFrame:
    """(keys, text): the parts (rel, caption, text) in order, each behind a mark of its origin, captions as headings."""
    from lectern.functions.text import strip
    from lectern.operators.lines import concat_ordered

    head = F.concat(F.lit("\n\n# Part: "), F.col("new_caption"), F.lit("\n\n"))
    body = F.concat(F.lit("\n\n<!-- FILE: "), F.col("rel"), F.lit(" -->\n\n"), F.coalesce(F.col("text"), F.lit("")))
    chunks = caption_changes(parts, keys, order).select(*keys, order, F.concat(F.coalesce(head, F.lit("")), body).alias("chunk"))
    out = concat_ordered(chunks, keys, [order], "chunk", "\n")
    text = F.concat(F.lit(f"# {title}\n\n"), F.col("text")) if title else F.col("text")
    return out.withColumn("text", F.concat(strip(text), F.lit("\n")))
