"""Parsers, file sources, consolidation, libraries and the incremental fold-in."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.errors import LecternError
from lectern.operators import consolidate, extract, library
from lectern.sources import files
from lectern.sources.markup import _OPF, _PAGES, _W, docx_to_text, epub_to_text, html_to_text, rtf_to_text
from lectern.streaming.fold_in import fold_in, with_offsets



def zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def tag(name: str, *inner: str, **attributes: str) -> str:
    given = "".join(f' {k.replace("_", ":")}="{v}"' for k, v in attributes.items())
    return f"<{name}{given}>{''.join(inner)}</{name}>"


def docx() -> bytes:
    def said(text: str) -> str:
        return tag("w:r", tag("w:t", text))

    title = tag("w:p", tag("w:pPr", tag("w:pStyle", w_val="Heading2")), said("Title"))
    cells = [tag("w:tc", tag("w:p", said(x))) for x in "ab"]
    table = tag("w:tbl", tag("w:tr", *cells), tag("w:tr", tag("w:tc")))
    body = tag("w:body", title, tag("w:p", said("one"), tag("w:r", tag("w:tab")), said("two")), tag("w:p"), table)
    return zipped({"word/document.xml": tag("w:document", body, xmlns_w=_W[1:-1])})


def epub(*spine: str) -> bytes:
    kinds = {"a": ("a.xhtml", _PAGES[1]), "b": ("x/../b.xhtml", _PAGES[1]), "css": ("c.css", "text/css")}
    items = [f'<item id="{k}" href="{h}" media-type="{m}"/>' for k, (h, m) in kinds.items()]
    opf = tag("package", tag("manifest", *items), tag("spine", *[tag("itemref", idref=x) for x in spine]), xmlns=_OPF[1:-1])
    container = tag("container", tag("rootfiles", '<rootfile full-path="OEBPS/p.opf"/>'), xmlns="urn:oasis:names:tc:opendocument:" + "xmlns:container")
    return zipped({"OEBPS/a.xhtml": "<p>first in zip</p>", "OEBPS/b.xhtml": "<h1>second</h1>", "OEBPS/p.opf": opf, "META-INF/container.xml": container})


@pytest.mark.parametrize(("markup", "text"), [
    ("<h2>Head</h2><p>Body</p>", "\n\n## Head\n\nBody\n"), ("<p>a <b>bold</b>. x</p>", "\n\na bold. x\n"), ("<b>a</b>b", "a b"), ("<head><title>t</title></head>x<script>y</script>", "x"), ("<pre>a  b\n</pre>", "\n\n```\na  b\n\n```\n"),
    ("<table><tr><th>left</th><td>right</td></tr></table>", "\n| left | right |\n"), ("a&amp;b &#233;", "a&b é"), ("<style>unclosed", ""), ("", ""),
])
def test_html(markup, text):
    assert html_to_text(markup) == text


def test_zip_formats():
    assert docx_to_text(docx()) == "## Title\n\none\ttwo\n\n| a | b |"
    assert epub_to_text(epub("b", "a", "css"), files.decode) == "# second\n\nfirst in zip"
    assert epub_to_text(epub(), files.decode) == "first in zip\n\n# second"


def code(n: int) -> str:
    return chr(92) + f"u{n}?"


def test_rtf():
    raw = r"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\title x}}Hello\par \'e9" + code(20013) + r" \b bold\b0\tab x \{y\}}"
    assert rtf_to_text(raw) == "Hello\n é中 bold x y"
    assert rtf_to_text(r"{\rtf1 unclosed {\fonttbl x") == "unclosed"


@pytest.mark.parametrize(("data", "text"), [("é".encode(), "é"), (b"\xef\xbb\xbfx", "x"), ("中文".encode("gb18030"), "中文"), (b"", ""), (b"\xff\xfe\xfd\x81", None)])
def test_decode(data, text):
    assert files.decode(data) == text if text is not None else isinstance(files.decode(data), str)


def test_files_to_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.md").write_text("# A\n\nChapter 1: One\n")
    (tmp_path / "b" / "x.docx").write_bytes(docx())
    (tmp_path / "b" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "b" / "bad.epub").write_bytes(zipped({"META-INF/container.xml": "<broken"}))
    (tmp_path / "b" / "skip.xyz").write_text("no")
    (tmp_path / "z.html").write_text("<h1>T</h1><p>x</p>")
    (tmp_path / "s.rtf").write_text(r"{\rtf1 " + code(55357) + code(56832) + "}")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-")
    found = files.read_files(spark, [str(tmp_path), str(tmp_path / "b" / "skip.xyz"), str(tmp_path / "a.md")])
    parsed = files.parse_files(found).join(found.select("seq", "path"), "path").checkpoint()
    assert parsed.count() == found.count() == 8
    sources, failures = extract.extract(parsed)
    rows = {r.filename: r for r in sources.collect()}
    assert set(rows) == {"a.md", "x.docx", "z.html", "s.rtf"} and rows["a.md"].chapters_detected == 1 and rows["x.docx"].format == "docx"
    assert rows["s.rtf"].text == "\U0001f600\n"
    assert {r.filename for r in failures.collect()} == {"bad.docx", "bad.epub", "skip.xyz", "p.pdf"}
    assert [r.filename for r in sources.orderBy("start_line").collect()] == [r.filename for r in sources.orderBy("seq").collect()]
    meta = extract.metadata_json(sources, failures).first().metadata
    assert '"total_sources":4' in meta and "bad.docx" in meta
    with pytest.raises(LecternError, match="mode"):
        files.parse_files(found, "strange")
    errors = {r.filename: r.error.split(":")[0] for r in failures.collect()}
    assert errors["skip.xyz"] == "UnsupportedFormat" and errors["bad.docx"] == "BadZipFile" and (errors["p.pdf"] == "MissingDependency" or files.pdf_backend())


def test_folders_with_dots_files_without_suffix_and_order(spark, tmp_path):
    book = tmp_path / "book.v2"
    (book / "sub").mkdir(parents=True)
    for name in ("c.xyz", "sub/b.txt", "a.txt", "B.txt", "sub2.md"):
        (book / name).write_text(name)
    (tmp_path / "NOEXT").write_text("bare")
    found = files.read_files(spark, [str(tmp_path / "NOEXT"), str(book), str(tmp_path / "book.v2" / "a.txt"), str(book / "*.md")])
    got = [(r.seq, r.path.rpartition("/book.v2/")[2] if "book.v2" in r.path else "NOEXT") for r in found.orderBy("seq").collect()]
    assert got == [(1, "NOEXT"), (2, "B.txt"), (3, "a.txt"), (4, "sub/b.txt"), (5, "sub2.md")]
    with pytest.raises(LecternError, match="no paths"):
        files.read_files(spark, [])


def test_parts_are_read_whatever_they_are(spark):
    rows = [("a.Rmd", b"# R\xff"), ("b.ipynb", b"{}"), ("c.html", b"<p>x</p>"), ("d.docx", b"no zip"), ("e.md", None)]
    got = {r.path: r.text for r in files.read_parts(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")).collect()}
    assert got["a.Rmd"] == "# R\ufffd" and got["b.ipynb"] == "{}" and got["c.html"].strip() == "x" and got["d.docx"] == "no zip" and got["e.md"] == ""
    parts, _ = consolidate.plan_rows(spark, "s", consolidate.Plan("natural", parts=[("c.html", "One"), ("a.Rmd", None), ("gone.md", None)]))
    texts = spark.createDataFrame(list(got.items()), "path string, text string")
    assert consolidate.consolidated(parts, texts, "T").first().text == "# T\n\n\n\n# Part: One\n\n\n\n<!-- FILE: c.html -->\n\n" + got["c.html"] + "\n\n\n<!-- FILE: a.Rmd -->\n\n# R\ufffd\n\n\n<!-- FILE: gone.md -->\n"


def test_lines_of_sources_by_range(spark, monkeypatch):
    from lectern.operators import lines

    monkeypatch.setattr(lines, "SLICE", 4)
    corpus = spark.createDataFrame([(i, f"l{i}") for i in range(1, 60)], "line_no bigint, line string")
    spans = spark.createDataFrame([("a", 4, 20), ("b", 21, 21), ("c", 30, 29), ("d", 40, 59), ("e", 10, 12)], "filename string, start_line bigint, end_line bigint")
    got = sorted((r.filename, r.line_no) for r in lines.slice_sources(corpus, spans).collect())
    assert got == sorted([*(("a", i) for i in range(4, 21)), ("b", 21), *(("d", i) for i in range(40, 60)), *(("e", i) for i in range(10, 13))])


def test_gate_over_files_and_standard_input(spark, tmp_path, capsys):
    import io
    import json

    from lectern.plans import gate

    (tmp_path / "a.md").write_text("---\nx: 1\n---\n" + "word " * 100)
    (tmp_path / "b.md").write_text("short")
    assert gate.main([str(tmp_path), "--budget", "50", "--json"]) == 1
    got = json.loads(capsys.readouterr().out)
    assert got["over"] == 1 and got["total_tokens"] == sum(r["tokens"] for r in got["files"]) and [r.get("over_budget", False) for r in got["files"]] == [True, False]
    assert gate.main([str(tmp_path), "--budget", "500"]) == 0 and "all  " in capsys.readouterr().out
    assert gate.main(["--json"], io.StringIO("eight ch")) == 0 and json.loads(capsys.readouterr().out)["files"] == [{"path": "-", "tokens": 2}]
    assert gate.main(["--body-only", "--json"], io.StringIO("---\nx: 1\n---\nabcd")) == 0 and json.loads(capsys.readouterr().out)["total_tokens"] == 1


def test_cleaned_texts_and_their_report_as_tables(spark, tmp_path):
    from lectern.operators import denoise

    docs = spark.createDataFrame([(1, "Skip to main content\n\n\n\nbody\n")], "doc_id int, text string")
    denoise.write_cleaned(denoise.clean(docs), ["doc_id"], str(tmp_path / "c"))
    report = spark.read.json(str(tmp_path / "c" / "report")).first()
    assert spark.read.parquet(str(tmp_path / "c" / "text")).first().text == "body\n" and report.lines_after < report.lines_before and report.tokens_saved > 0 and report.percent_saved > 0


def test_capabilities():
    assert files.capabilities()[0]["available"] and files.missing_for({".md"}) == []
    assert {".pdf"} == {c["formats"] for c in files.missing_for({".pdf", ".txt"})} or files.pdf_backend()


TREE = {
    "index.rst": "Title\n~~~~~\n\n.. toctree::\n   :maxdepth: 2\n   :caption: Start\n\n   Intro <intro>\n   part/overview\n\nend\n\n.. toctree::\n\n   Last </last>\n   missing\n",
    "intro.rst": "", "part/overview.rst": ".. toctree::\n\n   ch10\n   ch2\n   ../index\n   overview\n", "part/ch2.md": "", "part/ch10.rst": "", "last.md": "", "orphan.rst": "", "conf.py": "",
}


def test_declared_orders():
    plan = consolidate.build_plan(TREE)
    assert plan.order == "sphinx" and plan.parts == [("intro.rst", "Start"), ("part/overview.rst", "Start"), ("part/ch10.rst", "Start"), ("part/ch2.md", "Start"), ("last.md", None)]
    assert plan.unreached == ["orphan.rst"]
    docs = consolidate.build_plan({f"docs/{k}": v for k, v in TREE.items()})
    assert (docs.root, docs.parts, docs.unreached) == ("docs", plan.parts, plan.unreached)
    assert consolidate.plan_sphinx(TREE, max_depth=1).parts == [("intro.rst", "Start"), ("part/overview.rst", "Start"), ("last.md", None)]
    book = {"_toc.yml": "root: intro\nparts:\n- caption: One\n  sections:\n  - file: a\n  - file: intro\n- caption: Two\n  - file: b.md\n  - file: gone\n", "intro.md": "", "a.md": "", "b.md": "", "c.md": ""}
    plan = consolidate.build_plan(book)
    assert plan.parts == [("intro.md", None), ("a.md", "One"), ("b.md", "Two")] and plan.unreached == ["c.md"]
    names = ["ch10.md", "x/ch1.md", "ch2.md", "a.png", "b.html"]
    assert [r for r, _ in consolidate.plan_natural(names).parts] == ["b.html", "ch2.md", "ch10.md", "x/ch1.md"]
    assert [r for r, _ in consolidate.plan_natural(names, include=("*.md", "x/*"), exclude=("ch1*",)).parts] == ["ch2.md", "x/ch1.md"]
    assert consolidate.build_plan({"a.md": ""}, "sphinx").order == "natural"


def test_render(spark):
    parts = spark.createDataFrame([("s", 1, "a.md", "One", "A"), ("s", 2, "b.md", None, "B"), ("s", 3, "c.md", "One", "C"), ("s", 4, "d.md", "Two", None), ("s", 5, "e.md", "", "E")], "source string, seq int, rel string, caption string, text string")
    out = consolidate.render(parts, ["source"], title="Book").first().text
    assert out.startswith("# Book\n") and out.count("# Part: One") == 1 and out.count("# Part: Two") == 1 and out.endswith("E\n")
    assert [out.index(f"<!-- FILE: {x}.md -->") for x in "abcde"] == sorted(out.index(f"<!-- FILE: {x}.md -->") for x in "abcde")


def checks(spark, tree: dict[str, str]) -> set:
    df = spark.createDataFrame([("l", p, t) for p, t in tree.items()], "library string, path string, text string")
    return {(r.severity, r.check, r.subject) for r in library.validate(df).collect()}


REFERENCE = "# Book\n**Sections**: ~4 **Depth**: study\n## Mental Model\n## Frameworks & Structure\n## Key Takeaways\n## Decision Rules & Judgment\n## Worked Example\n"
ROUTER = "---\nname: my-library\ndescription: a library that is about a number of good things\n---\n# L\n## Which book for which job\n[a](references/reference-a.md) [w](https://x.org)\n[b](references/reference-b.md#top)\n## Topic Index\n- trade -> reference-a, references/reference-b.md\n"


def test_validate(spark):
    good = {"SKILL.md": ROUTER, "references/reference-a.md": REFERENCE, "references/reference-b.md": REFERENCE}
    assert checks(spark, good) == set()
    bad = checks(spark, {
        "SKILL.md": ROUTER.replace("my-library", "Claude Lib").replace("[b](references/reference-b.md#top)", "[b](reference-b.md) [t](<slug>) [g](gone.md)").replace(", references/reference-b.md", ", nobook").replace("good things", "x") + "- one -> a\n",
        "references/reference-b.md": REFERENCE.replace("## Key Takeaways\n", "").replace("study", "reference") + "## Worked Example 2\n" + "word " * 12000, "references/reference-a.md": REFERENCE.replace("# Book\n", "", 1).replace("**Sections**: ~4", ""),
        "reference-c.md": "", "odd.txt": "", "chapters/x.md": "", "references/deep/x.md": "", "references/Odd.md": "",
    })
    assert {("error", "bad-name", "SKILL.md"), ("error", "dangling-link", "reference-b.md"), ("error", "dangling-link", "gone.md"), ("error", "placeholder-link", "<slug>"), ("error", "unreachable", "references/reference-b.md"), ("warning", "index-unknown-book", "trade"), ("error", "index-few-books", "one"), ("error", "over-cap", "reference-b.md"), ("error", "missing-section", "reference-b.md"), ("error", "worked-example-in-reference", "reference-b.md"), ("error", "many-worked-examples", "reference-b.md"), ("error", "no-title", "reference-a.md"), ("warning", "no-sections", "reference-a.md"), ("error", "reference-at-root", "reference-c.md"), ("warning", "unexpected-root-file", "odd.txt"), ("error", "extra-folder", "chapters"), ("error", "nested-folder", "deep"), ("warning", "unexpected-reference-file", "Odd.md")} <= bad
    assert checks(spark, {"references/reference-a.md": "x"}) == {("error", "router-missing", "SKILL.md")}
    assert ("error", "no-frontmatter", "SKILL.md") in checks(spark, {"SKILL.md": "# x"})


def test_audit_and_fields(spark):
    skill = "---\nname: ok-name\ndescription: >\n  folded over\n  two lines and long enough for it\nallowed-tools: x\n---\n# T\n"
    df = spark.createDataFrame([("l", skill), ("m", "none"), ("n", "---\nname: Bad Name\n---\n")], "library string, text string")
    amp = {(r.library, r.check, r.detail) for r in library.audit(df, "amp").collect()}
    assert ("l", "unknown-key", "allowed-tools") in amp and ("m", "no-frontmatter", "") in amp and ("n", "bad-name", "Bad Name") in amp and ("n", "no-description", "") in amp
    assert not [r for r in library.audit(df, "claude").where("library = 'l'").collect()]
    got = df.where("library = 'l'").select(library.fields(library.frontmatter(F.col("text"))).alias("f")).first().f
    assert got["description"] == "> folded over two lines and long enough for it"


def test_fold_in_in_two_batches_equals_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "line\n" * (i % 4) + f"doc {i}") for i in range(20)], "doc_id bigint, text string")
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("doc_id < 11", "doc_id >= 11"):
        docs.where(part).coalesce(1).write.mode("append").parquet(arrivals)
        fold_in(spark, arrivals, docs.schema, out, str(tmp_path / "state"))
    fold_in(spark, arrivals, docs.schema, out, str(tmp_path / "state"))
    two = with_offsets(spark.read.parquet(out)).select("doc_id", "chars", "words", "start_line", "end_line").orderBy("doc_id").collect()
    fold_in(spark, arrivals, docs.schema, str(tmp_path / "out1"), str(tmp_path / "state1"))
    one = with_offsets(spark.read.parquet(str(tmp_path / "out1"))).select("doc_id", "chars", "words", "start_line", "end_line").orderBy("doc_id").collect()
    assert two == one and len(two) == 20


def test_run_writes_everything(spark, tmp_path):
    from lectern.plans.run import main, run

    (tmp_path / "in").mkdir()
    for n, text in (("b.md", "# B\n\nSOURCE: forged\nline"), ("a.txt", "Chapter 1: A\nword")):
        (tmp_path / "in" / n).write_text(text)
    out = str(tmp_path / "out")
    sources, failures = run(spark, [str(tmp_path / "in")], out)
    assert sources.count() == 2 and failures.count() == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "full_text").glob("part-*")))
    whole = text.split("\n")
    assert text.count("\nSOURCE: ") == 2 and "[quoted] SOURCE: forged" in text
    for r in sources.collect():
        assert "\n".join(whole[r.start_line - 1 : r.end_line]) + "\n" == r.text
    assert extract.resolve_source(sources, "a.txt").count() == 1
    assert not (tmp_path / "out" / "metadata").exists()
    run(spark, [str(tmp_path / "in")], out, metadata=True)
    assert '"total_sources":2' in spark.read.text(f"{out}/metadata").first().value
    assert spark.read.parquet(f"{out}/lines").where("filename = 'a.txt'").count() == 2
    assert main(["--check"]) == 0
    with pytest.raises(ValueError, match="no supported"):
        run(spark, [str(tmp_path / "out" / "lines")], str(tmp_path / "other"))


def test_read_tree_and_unreadable_files(spark, tmp_path):
    from lectern.operators import scan

    (tmp_path / "references").mkdir()
    (tmp_path / "SKILL.md").write_text(ROUTER)
    (tmp_path / "references" / "reference-a.md").write_text(REFERENCE)
    (tmp_path / "references" / "odd.md").write_bytes(bytes([255, 254]))
    tree = files.read_tree(spark, str(tmp_path), "*.md")
    assert {r.path for r in tree.collect()} == {"SKILL.md", "references/reference-a.md", "references/odd.md"}
    assert [r.path for r in scan.unreadable(tree, ["path"]).collect()] == ["references/odd.md"]
    assert {r.check for r in library.validate(tree.where("error is null").withColumn("library", F.lit("l"))).collect()} == {"dangling-link", "index-unknown-book"}
