"""Markup formats as text with their structure kept: headings as #, table rows as pipes, code fenced.

Plain functions of one document; ``lectern.sources.files`` and the ``html_text`` expression run
them over Arrow batches. HTML is a state machine over tags, DOCX and EPUB are zip archives of XML,
RTF is a stream of groups and control words; Spark has no built-in reader for any of them.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIDDEN = frozenset("head noscript script style svg template".split())
BREAKING = {**dict.fromkeys("p div blockquote".split(), 2), **dict.fromkeys("article br figcaption figure hr li section".split(), 1)}
CELLS = frozenset(["td", "th"])
CLOSING = frozenset(BREAKING) | {"tr"} | {f"h{i}" for i in range(1, 7)}
TIGHT = frozenset("!'\"),.:;?]}”’、。，；：！？）」』")


class _Reader(HTMLParser):
    """Pieces of text; newlines are pieces of their own, so that a run of them can be taken back."""

    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = self.verbatim = 0
        self.in_row = False

    def lines(self, n: int) -> None:
        while self.out and self.out[-1] == "\n":
            del self.out[-1]
        self.out += ["\n"] * n

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "pre":
            self.verbatim += 1
            self.lines(2)
            self.out.append("```\n")
        elif len(tag) == 2 and tag[0] == "h" and tag in CLOSING and tag != "hr":
            self.lines(2)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in CELLS:
            self.out.append(" | " if self.in_row else "| ")
            self.in_row = True
        elif tag == "tr":
            self.lines(1)
            self.in_row = False
        elif tag in BREAKING:
            self.lines(BREAKING[tag])

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif self.hidden:
            return
        elif tag == "pre":
            self.verbatim = max(self.verbatim - 1, 0)
            self.lines(1)
            self.out.append("```\n")
        elif tag in CLOSING:
            if tag == "tr":
                self.out += [" |"] * self.in_row
                self.in_row = False
            self.lines(1)

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.verbatim:
            data = " ".join(data.split())
            if data and self.out and self.out[-1][-1:] not in ("\n", " ", "#") and data[0] not in TIGHT:
                self.out.append(" ")
        if data:
            self.out.append(data)


def html_to_text(markup: str) -> str:
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return "".join(reader.out)


_W = "{http://schemas.openxmlformats.org/" + "wordprocessingml/2006/main}"


def _said(paragraph: ElementTree.Element) -> str:
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in paragraph.iter()).strip()


def docx_to_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        raise ValueError("no document body")
    blocks = []
    for x in body:
        if x.tag == f"{_W}p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            text = _said(x)
            blocks.append(f"{'#' * int(level[1])} {text}" if level and text else text)
        elif x.tag == f"{_W}tbl":
            rows = [[" ".join(map(_said, c.findall(f"{_W}p"))).strip() for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
            blocks.append("\n".join(f"| {' | '.join(r)} |" for r in rows if any(r)))
    return "\n\n".join(filter(None, blocks))


_OPF = "{http://www.idpf.org/2007/opf}"
_PAGES = ("text/html", "application/xhtml+xml")


def epub_to_text(data: bytes, decode: Callable[[bytes], str]) -> str:
    """Documents in the order of the spine, or of the manifest where the spine names none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{urn:oasis:names:tc:opendocument:xmlns:container}rootfile")
        opf = root.get("full-path") if root is not None else None
        if not opf:
            raise ValueError("the container declares no root file")
        package = ElementTree.fromstring(z.read(opf))
        items = {x.get("id"): (x.get("href"), x.get("media-type", "")) for x in package.iterfind(f".//{_OPF}manifest/{_OPF}item") if x.get("id") and x.get("href")}
        refs = [items.get(x.get("idref", "")) for x in package.iterfind(f".//{_OPF}spine/{_OPF}itemref")]
        chosen = [h for h, kind in filter(None, refs) if not kind or kind in _PAGES] or [h for h, kind in items.values() if kind in _PAGES]
        names = set(z.namelist())
        base = posixpath.dirname(opf)
        paths = [posixpath.normpath(posixpath.join(base, h)) if base else h for h in chosen]
        texts = [html_to_text(decode(z.read(p))).strip() for p in paths if p in names]
    if not texts:
        raise ValueError("no readable documents")
    return "\n\n".join(filter(None, texts))


RTF_METADATA = "colortbl fonttbl generator info listoverridetable listtable pict rsidtbl stylesheet".split()


def _without_groups(text: str) -> str:
    """RTF without the groups that hold no body text."""
    start = re.compile(r"\{\\(?:" + "|".join(RTF_METADATA) + ")")
    out, at = [], 0
    while m := start.search(text, at):
        out.append(text[at : m.start()])
        depth, at = 0, len(text)
        for brace in re.compile(r"[{}]").finditer(text, m.start()):
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                at = brace.end()
                break
    return "".join([*out, text[at:]])


def rtf_to_text(raw: str) -> str:
    text = _without_groups(raw)
    text = re.sub(r"\\u(-?[0-9]+)\s?\??", lambda m: chr(int(m[1]) & 0xFFFF), text)
    text = re.sub(r"\\'([\da-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", errors="replace"), text)
    for pattern, by in ((r"\\tab\b", "\t"), (r"\\(?:line|pard?|sect)\b", "\n"), (r"\\([{}\\])", r"\1"), (r"\\\*?[A-Za-z]+-?\d*\s?", ""), (r"[{}]", ""), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, by, text)
    return text.strip()


@F.arrow_udf(StringType())
def html_text(markup: pa.Array) -> pa.Array:
    """Text of HTML columns, over Arrow batches; null stays null."""
    return pa.array([None if x is None else html_to_text(x) for x in markup.to_pylist()], pa.string())
