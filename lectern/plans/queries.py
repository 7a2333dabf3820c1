"""The library's own queries by name, each over its whole tables, and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import budgets, numerals
from lectern.functions import text as tx
from lectern.operators import consolidate, denoise, extract, library, lines, probe, sanitize, scan, structure
from lectern.plans import inputs, oracles
from lectern.session import spread, table
from lectern.sources.files import decoded, parse_files, read_parts
from lectern.sources.markup import html_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def extract_documents(spark, sf_dir):
    """Documents measured, with their chapters and their span in the fenced corpus. In prose, a word such as ``Chvi`` is no chapter."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return extract.placed(docs.withColumn("text", sanitize.sanitize(F.coalesce("text", F.lit("")))), ["doc_id"], strict=True)


@query
def extracted_books(spark, sf_dir):
    """Books as parsed files, from sanitising to their place in the corpus; every fifth one failed."""
    from pyspark.sql import Window

    parsed = inputs.books(spark, sf_dir).withColumn("seq", F.row_number().over(Window.orderBy("doc_id")))  # a row for each brand
    failed = F.col("seq") % 5 == 0
    parsed = parsed.select("seq", F.concat(F.lit("shelf/"), F.col("doc_id"), F.lit(".MD")).alias("path"), F.when(~failed, F.col("text")).alias("text"), F.lit(None).cast("int").alias("pages"), F.when(failed, F.lit("broken")).alias("error"))
    sources, failures = extract.extract(parsed)
    cols = ["seq", "filename", "path", "format"]
    good = sources.select(*cols, "chars", "words", "estimated_tokens", "pages", "chapters_detected", "has_toc", "start_line", "end_line", F.md5("text").alias("digest"), F.lit("").alias("error"))
    return good.unionByName(failures.select(*cols, "error"), allowMissingColumns=True).fillna(0).fillna("").fillna(False)


@query
def document_totals(spark, sf_dir):
    return extract.total_cost(extract.measure(spread(table(spark, sf_dir, "documents").select("text"))).select("estimated_tokens"))


@query
def dense_scripts(spark, sf_dir):
    """Tokens and words of text that mixes scripts, a row for each part."""
    text = F.concat(F.col("p_name"), F.lit(" "), F.repeat(F.lit("汉字 "), F.col("p_size") % 7), F.repeat(F.lit("かな"), F.col("p_size") % 5), F.lit(" ไทย한x "), F.col("p_type"))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return parts.select("p_partkey", tx.count_dense(F.col("t")).alias("dense"), tx.estimate_tokens(F.col("t")).alias("tokens"), tx.count_words(F.col("t")).alias("words"))


@query
def sanitized_documents(spark, sf_dir):
    clean = sanitize.sanitized(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def sanitized_books(spark, sf_dir):
    """Books made dirty: carriage returns, runs of blanks and of lines, combining marks, forged fences."""
    dirt = F.concat(F.lit("  \r\n\r\n\n\n\n\x07éa    b\t\t\tc  \n"), F.lit(sanitize.RULE), F.lit("\r" + sanitize.MARKER + "x "), F.col("text"))
    return inputs.books(spark, sf_dir).select("doc_id", sanitize.sanitize(dirt).alias("text"))


@query
def book_headings(spark, sf_dir):
    return structure.heading_rows(inputs.books(spark, sf_dir))


@query
def book_structure(spark, sf_dir):
    return structure.detect_structure(inputs.books(spark, sf_dir)).select("doc_id", "chapters", "has_toc")


@query
def numeral_systems(spark, sf_dir):
    n = inputs.numerals(spark, sf_dir)
    return n.select("p_partkey", numerals.parse_roman(F.col("roman")).alias("roman"), numerals.parse_han(F.col("han")).alias("han"), numerals.parse_thai(F.col("thai")).alias("thai"), numerals.parse_arabic(F.col("wide")).alias("arabic"))


@query
def probe_candidates(spark, sf_dir):
    return probe.candidate_rows(probe.probe(inputs.books(spark, sf_dir)))


@query
def probe_scores(spark, sf_dir):
    return probe.probe(inputs.books(spark, sf_dir)).select("doc_id", "total_lines", "strategy", "n", "score")


@query
def probe_best(spark, sf_dir):
    return probe.best(probe.probe(inputs.books(spark, sf_dir)))


@query
def probe_ranked(spark, sf_dir):
    return probe.ranked(probe.probe(inputs.books(spark, sf_dir)))


def _filtered(name: str) -> None:
    QUERIES[f"filter_{name}"] = lambda spark, sf_dir: denoise.filtered_lines(inputs.books(spark, sf_dir), name, ["doc_id"])


for _name in denoise.FILTERS:
    _filtered(_name)


@query
def repeated_lines_dropped(spark, sf_dir):
    """Lines of each document before and after its repeated ones are dropped."""
    cleaned = denoise.clean(table(spark, sf_dir, "documents"), filters=("repeats",))
    return cleaned.select("doc_id", "lines_before", "lines_after")


@query
def detected_filters(spark, sf_dir):
    return inputs.books(spark, sf_dir).select("doc_id", F.array_join(denoise.detect_filters(F.col("text")), ",").alias("filters"))


@query
def cleaned_books(spark, sf_dir):
    out = denoise.clean(inputs.books(spark, sf_dir))
    return out.select("doc_id", "lines_before", "lines_after", "percent_removed", "tokens_before", "tokens_after", "tokens_saved", "percent_saved", F.md5("text").alias("digest"))


@query
def scan_findings(spark, sf_dir):
    return scan.scan(inputs.books(spark, sf_dir), ["doc_id"]).select("doc_id", "line", "severity", "rule", "excerpt")


@query
def forged_findings(spark, sf_dir):
    return scan.scan(inputs.forged(spark, sf_dir), ["doc_id"]).select("doc_id", "line", "severity", "rule", "excerpt")


@query
def scan_outcomes(spark, sf_dir):
    """Which texts pass a strict scan, those that couldn't be read among them."""
    forged = inputs.forged(spark, sf_dir).withColumn("error", F.when(F.col("doc_id").endswith("3"), F.lit("not UTF-8")))
    return scan.outcomes(scan.scan_parsed(forged, ["doc_id"]), ["doc_id"], strict=True)


@query
def ranked_findings(spark, sf_dir):
    found = scan.ranked(scan.scan(inputs.forged(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "place", "severity", "line", "rule")


@query
def scanned_documents(spark, sf_dir):
    """The injection scan over all documents."""
    return scan.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]).select("doc_id", "line", "severity", "rule", "excerpt")


@query
def findings_by_severity(spark, sf_dir):
    return scan.by_severity(scan.scan(inputs.books(spark, sf_dir), ["doc_id"]))


@query
def source_line_spans(spark, sf_dir):
    """Conversations as sources of the corpus."""
    said = lines.concat_ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), ["conv_id"], ["turn"], "text", "\n")
    return lines.source_spans(said, ["conv_id"])


@query
def fenced_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = lines.fenced_blocks(docs, F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string")), F.col("text"))
    return out.select("doc_id", F.length("block").alias("chars"), F.md5("block").alias("digest"))


@query
def corpus_lines(spark, sf_dir):
    return lines.lines(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def rendered_conversations(spark, sf_dir):
    """Each conversation consolidated: turns are parts, roles are captions."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("rel"), F.col("role").alias("caption"), "text")
    return consolidate.render(parts, ["conv_id"]).select("conv_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def caption_runs(spark, sf_dir):
    """Orders of a customer as parts: captions are priorities, some of them empty."""
    caption = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    parts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", caption.alias("caption"))
    changed = consolidate.caption_changes(parts, ["o_custkey"], "o_orderkey")
    return consolidate.carry_captions(changed, ["o_custkey"], "o_orderkey").select("o_orderkey", "new_caption", F.col("caption").alias("carried"))


@query
def reference_budgets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sections, depth, kind = F.col("o_orderkey") % 60, F.when(F.col("o_orderstatus") == "F", "study").otherwise("reference"), F.when(F.col("o_custkey") % 2 == 0, "text").otherwise("technical")
    return o.select("o_orderkey", budgets.reference_budget(sections, depth, kind).alias("budget"), budgets.reference_cap(depth, kind).alias("cap"))


@query
def master_budgets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", budgets.master_budget(F.col("c_custkey") % 40, F.col("c_nationkey") - 3, F.col("c_custkey") % 31).alias("budget"))


@query
def library_references(spark, sf_dir):
    return library.reference_files(inputs.libraries(spark, sf_dir))


@query
def library_routers(spark, sf_dir):
    return library.routers(inputs.libraries(spark, sf_dir))


@query
def library_density(spark, sf_dir):
    return library.density(inputs.libraries(spark, sf_dir))


@query
def library_budget_report(spark, sf_dir):
    return library.budget_report(inputs.libraries(spark, sf_dir))


@query
def library_layout(spark, sf_dir):
    return library.layout_violations(inputs.libraries(spark, sf_dir))


@query
def library_frontmatter(spark, sf_dir):
    return library.frontmatter_violations(inputs.libraries(spark, sf_dir))


@query
def library_links(spark, sf_dir):
    return library.router_violations(inputs.libraries(spark, sf_dir))


@query
def library_index(spark, sf_dir):
    return library.index_violations(inputs.libraries(spark, sf_dir))


@query
def library_violations(spark, sf_dir):
    return library.validate(inputs.libraries(spark, sf_dir))


@query
def skill_audit(spark, sf_dir):
    skills = inputs.libraries(spark, sf_dir).where("path = 'SKILL.md'")
    return library.audit(skills.withColumn("directory", F.lit("skill")), "amp")


for _lens in library.LENSES:
    QUERIES[f"skill_audit_{_lens}"] = lambda spark, sf_dir, lens=_lens: library.audit(inputs.skills(spark, sf_dir).withColumn("directory", F.lit("skill")), lens)


@query
def faulty_libraries(spark, sf_dir):
    return library.validate(inputs.faulty_libraries(spark, sf_dir))


@query
def library_reports(spark, sf_dir):
    """The violations of each library as a report."""
    return library.reports(library.validate(inputs.faulty_libraries(spark, sf_dir)))


@query
def token_gate_totals(spark, sf_dir):
    return library.gate_totals(library.token_gate(table(spark, sf_dir, "documents"), 1000))


@query
def sliced_sources(spark, sf_dir):
    """Conversations as sources of the corpus: the corpus' lines by number, joined back to the sources they are in."""
    said = lines.concat_ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), ["conv_id"], ["turn"], "text", "\n")
    spans = lines.source_spans(said, ["conv_id"]).checkpoint()
    corpus = said.join(spans, "conv_id").select("start_line", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select((F.col("start_line") + F.col("pos")).alias("line_no"), "line")
    return lines.slice_sources(corpus, spans.where("conv_id % 7 = 3")).select("conv_id", "line_no", "line")


@query
def input_budget_gate(spark, sf_dir):
    """Documents read in order against an output budget."""
    sized = extract.measure(table(spark, sf_dir, "documents")).select("doc_id", "estimated_tokens")
    return extract.input_gate(sized, ["doc_id"], "estimated_tokens", 20_000)


@query
def tokens_per_word(spark, sf_dir):
    sized = extract.measure(table(spark, sf_dir, "documents")).select("doc_id", F.col("estimated_tokens").alias("tokens"), (F.col("words") % 40).alias("items"))
    return extract.tokens_per_item(sized, "tokens", "items")


@query
def fallback_chapters(spark, sf_dir):
    return structure.fallback_probe(inputs.books(spark, sf_dir))


@query
def candidates_shown(spark, sf_dir):
    """The first three candidates of each strategy, as a report shows them."""
    return probe.candidate_rows(probe.shown(probe.probe(inputs.books(spark, sf_dir)), 3))


@query
def token_gate(spark, sf_dir):
    return library.token_gate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 1000).select("doc_id", "tokens", "over")


@query
def code_tripwires(spark, sf_dir):
    return library.tripwires(inputs.books(spark, sf_dir), ["doc_id"])


@query
def natural_order(spark, sf_dir):
    """Paths of the parts by natural order: rank of each."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Ch"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("path"))
    from pyspark.sql import Window

    first = F.regexp_extract("path", "^Ch([0-9]+)/", 1)
    return p.select("p_partkey", first.alias("chapter"), F.row_number().over(Window.partitionBy(first).orderBy(tx.natural_key(F.col("path")))).alias("place"))


@query
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.link_host(F.col("url")).alias("host"))


@query
def page_texts(spark, sf_dir):
    """Pages as text with their structure kept."""
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query
def decoded_documents(spark, sf_dir):
    """Documents through bytes of several encodings and back."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(decoded(F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))))).alias("digest"))


@query
def parsed_formats(spark, sf_dir):
    """Suppliers as files of every format that needs no backend, parsed; what can't be is decoded as it is."""
    files = inputs.built_files(table(spark, sf_dir, "supplier"))
    parsed = parse_files(files).join(read_parts(files).withColumnRenamed("text", "part"), "path")
    kind = F.element_at(F.split("error", ":"), 1)
    return parsed.select("path", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), kind.alias("error"), F.col("text").eqNullSafe(F.col("part")).alias("same"))


@query
def parsed_pages(spark, sf_dir):
    """Pages as files of a source: parsed, sanitised and measured; those without a known format fail."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 10 == 9, ".xyz").otherwise(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"), F.col("page_id").alias("seq"))
    parsed = parse_files(files).join(files.select("path", "seq"), "path")
    sources, failures = extract.extract(parsed)
    cols = ["seq", "path", "format", "chars", "words", "estimated_tokens", "pages", "start_line", "end_line", "ok", "error"]
    good = sources.withColumns({"ok": F.lit(True), "error": F.lit("")}).select(*cols)
    zero = {c: F.lit(0) for c in ("chars", "words", "estimated_tokens", "pages")} | {c: F.lit(0).cast("bigint") for c in ("start_line", "end_line")}
    return good.unionByName(failures.withColumns(zero | {"ok": F.lit(False)}).select(*cols))


ORACLES: dict[str, str] = oracles.ORACLES
