"""Measurement and validation of generated libraries: a router file, and reference files beside it.

The input is a table of files (library, path, text), with paths relative to the library. Every
check is a DataFrame of (library, severity, check, subject, detail), and all of them are united.
A check is a set operation between files, links and required things: an anti join where the
reference-side sets are tables, an array expression where they belong to one file. Texts are measured
in their rows before any join; joins carry paths and measures, and those on paths broadcast nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.budgets import CAP_SECTIONS, MASTER_STOP, TOLERANCE, master_budget, reference_budget, reference_cap
from lectern.functions.text import estimate_tokens, let, split_lines, strip, strip_chars, strip_frontmatter
from lectern.session import once

ROUTER, FOLDER, INDEX = "SKILL.md", "references", "topic-index.md"
SLUG = r"[a-z0-9]+(?:-[a-z0-9]+)*"
REFERENCE = rf"\Areference-{SLUG}\.md\z"
RESERVED = ("anthropic", "claude")
REQUIRED_SECTIONS = ("Frameworks & Structure", "Key Takeaways", "Mental Model")
MAX_ENTRIES, MIN_BOOKS, MIN_DESCRIPTION, MAX_DESCRIPTION, MAX_NAME, SOFT_BODY = 40, 2, 40, 1024, 64, 12_000
MD_LINK = r"\[[^\]]+\]\(([^)]+)\)"
FRONTMATTER = r"(?s)\A-{3}\n(.*?)\n-{3}\n"
ENTRY = r"(?dm)^[*-]\s+(.*?)(?:->|→)(.*)$"
VIOLATION = ("library", "severity", "check", "subject", "detail")
LENSES = {
    "claude": ("allowed-tools", "description", "license", "metadata", "name", "version"),
    "copilot": ("description", "license", "name", "version"),
    "amp": ("description", "license", "name", "version"),
}
SHARE_BAND = (65.0, 85.0)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _counted(text: Column, held: str, pattern: str) -> Column:
    """The matches of a pattern, none of which is without ``held``."""
    return F.when(F.contains(text, F.lit(held)), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def frontmatter(text: Column) -> Column:
    return _found(text, FRONTMATTER)


def fields(block: Column) -> Column:
    """map of the keys of a frontmatter block; indented lines go on the value before them; a key's last value stands."""
    folded = F.regexp_replace(block, r"\n[ \t]+([^\n]*)", " $1")
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"\A[\w-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\A([\w-]+):", 1).alias("k"), strip(F.regexp_extract(x, r"\A[\w-]+:(.*)\z", 1)).alias("v")))
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(last)


def sections(text: Column) -> Column:
    """array<struct(title, body)> of the second-level headings."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(strip(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("title"), F.regexp_extract(p, r"(?s)\A[^\n]*(.*)\z", 1).alias("body")))


def titles(text: Column) -> Column:
    """The titles of ``sections`` in lower case, without a look at the bodies."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.lower(strip(F.substring_index(p, "\n", 1))))


def find_section(all_: Column, needle: str) -> Column:
    return F.get(F.filter(all_, lambda s: F.contains(F.lower(s["title"]), F.lit(needle.lower()))), F.lit(0))


def budget_type(text: Column) -> Column:
    """As the budget tool has it: six bare code fences or more are technical."""
    return F.when(_counted(text, "```", r"(?dm)^```(?!markdown(?:[^\w]|$))[.+#a-z0-9-]*\s*$") >= 6, "technical").otherwise("text")


def book_type(text: Column) -> Column:
    """As the validator has it: two code fences or a dozen table rows are technical."""
    fences, rows = _counted(text, "```", r"(?m)^```"), _counted(text, "|", r"(?dm)^\s*\|.*\|.*\|")
    return F.when((fences >= 2) | (rows >= 12), "technical").otherwise("text")


def declared_depth(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.lower(_found(text, r"(?i)[*]{2}Depth[*]{2}:\s*(reference|study)")), fallback)


def declared_sections(text: Column) -> Column:
    return F.regexp_extract(text, r"[*]{2}Sections[*]{2}:\s*~?(\d+)", 1).try_cast("int")


def frameworks_tokens(text: Column) -> Column:
    """Tokens of the section on frameworks, from its heading to the next one; 0 without it."""
    part = F.regexp_extract(F.concat(F.lit("\n"), text), r"\n(##\s+Frameworks\b(?:[^\n]++|\n(?!##\s))*+)", 1)
    return let(part, lambda p: F.when(p != "", estimate_tokens(p)).otherwise(0))


def index_entries(text: Column) -> Column:
    """array<struct(term, books)> of a topic index; books are slugs without folder, prefix and suffix."""
    def book(target: Column) -> Column:
        bare = F.element_at(F.split(strip_chars(strip(target), r"`*_\[\]()"), "/"), -1)
        return F.regexp_replace(F.regexp_replace(bare, r"\Areference-", ""), r"\.md\z", "")

    lines = F.regexp_extract_all(text, F.lit(ENTRY), F.lit(0))
    return F.transform(lines, lambda x: F.struct(
        strip_chars(strip(F.regexp_extract(x, ENTRY, 1)), "*` ").alias("term"),
        F.transform(F.filter(F.split(F.regexp_extract(x, ENTRY, 2), ","), lambda t: strip(t) != ""), book).alias("books"),
    ))


def _references(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", rf"\A{FOLDER}/([^/]+)\z", 1)
    return files.withColumn("name", name).where(F.col("name").rlike(REFERENCE)).withColumn("slug", F.regexp_extract("name", r"\Areference-(.*)\.md\z", 1))


def reference_files(files: DataFrame) -> DataFrame:
    """(library, name, sections, depth, type, tokens, budget, cap, frameworks_tokens) of each reference file."""
    text = F.col("text")
    rows = once(_references(files), ["library", "name"], sections=declared_sections(text), depth=declared_depth(text, F.lit("study")), type=budget_type(text), tokens=estimate_tokens(text), frameworks_tokens=frameworks_tokens(text))
    return rows.select(
        "library", "name", "sections", "depth", "type", "tokens",
        reference_budget(F.col("sections"), F.col("depth"), F.col("type")).alias("budget"), reference_cap(F.col("depth"), F.col("type")).alias("cap"),
        "frameworks_tokens",
    )


def routers(files: DataFrame) -> DataFrame:
    """(library, tokens, books, capabilities, index_entries, budget, hard_stop) of each router file."""
    body = strip_frontmatter(F.col("text"))
    tail = F.get(F.split(F.concat(F.lit("\n"), body), r"\n##\s+Cross-book"), F.lit(1))
    books = _references(files).groupBy("library").agg(F.count("*").cast("int").alias("books"))
    rows = once(
        files.where(F.col("path") == ROUTER), ["library"], tokens=estimate_tokens(body), capabilities=F.regexp_count(body, F.lit(r"(?m)^##\s+Capability\b")),
        index_entries=F.coalesce(F.regexp_count(tail, F.lit(r"(?dm)^\s*[|-]\s*\*\*.+?\*\*")), F.lit(0)),
    )
    rows = rows.join(books, "library", "left").withColumn("books", F.coalesce("books", F.lit(0)))
    return rows.select("library", "tokens", "books", "capabilities", "index_entries", master_budget(F.col("books"), F.col("capabilities"), F.col("index_entries")).alias("budget"), F.lit(MASTER_STOP).alias("hard_stop"))


def budget_report(files: DataFrame, strict: bool = False) -> DataFrame:
    """Violations of the budgets of reference files and routers; ``strict`` makes overruns errors."""
    over = "error" if strict else "warning"
    refs = reference_files(files).withColumn("delta", (F.col("tokens") - F.col("budget")) / F.col("budget"))
    state = F.when(F.col("budget").isNull(), "no-sections").when(F.col("tokens") > F.col("cap"), "over-cap").when(F.col("delta") > TOLERANCE, "over-budget").when(F.col("delta") < -TOLERANCE, "under-budget")
    one = refs.withColumn("check", state).where("check is not null").select("library", F.when(F.col("check") == "over-cap", "error").when(F.col("check") == "over-budget", over).otherwise("warning").alias("severity"), "check", F.col("name").alias("subject"), F.col("tokens").cast("string").alias("detail"))
    masters = routers(files)
    state = F.when(F.col("tokens") > MASTER_STOP, "master-over-stop").when((F.col("tokens") - F.col("budget")) / F.col("budget") > TOLERANCE, "master-over-budget")
    two = masters.withColumn("check", state).where("check is not null").select("library", F.when(F.col("check") == "master-over-stop", "error").otherwise(over).alias("severity"), "check", F.lit(ROUTER).alias("subject"), F.col("tokens").cast("string").alias("detail"))
    return one.unionByName(two)


def density(files: DataFrame) -> DataFrame:
    """(library, name, share, inside): the frameworks' share of each reference file, and whether it is in the measured band."""
    rows = reference_files(files).where("frameworks_tokens > 0 and budget is not null")
    return rows.select("library", "name", (F.col("frameworks_tokens") / F.col("tokens") * 100).alias("share")).withColumn("inside", F.col("share").between(*SHARE_BAND))


def _violations(df: DataFrame, *checks: tuple[str, str, Column, Column | None]) -> DataFrame:
    """Rows of (severity, check, when, detail) for each row of ``df`` (library, subject) that a condition holds for."""
    made = [F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))) for sev, name, cond, detail in checks]
    return df.select("library", "subject", F.explode(F.array_compact(F.array(*made))).alias("v")).select("library", "v.severity", "v.check", "subject", "v.detail")


def layout_violations(files: DataFrame) -> DataFrame:
    """Files and folders in the wrong place, and what is missing."""
    depth = F.size(F.split("path", "/"))
    top, second = F.get(F.split("path", "/"), F.lit(0)), F.get(F.split("path", "/"), F.lit(1))
    placed = files.select("library", "path", depth.alias("depth"), top.alias("top"), second.alias("second"))
    folders = placed.where((F.col("depth") > 1) & (F.col("top") != FOLDER)).select("library", F.lit("error").alias("severity"), F.lit("extra-folder").alias("check"), F.col("top").alias("subject"), F.lit("").alias("detail")).distinct()
    nested = placed.where((F.col("depth") > 2) & (F.col("top") == FOLDER)).select("library", F.lit("error").alias("severity"), F.lit("nested-folder").alias("check"), F.col("second").alias("subject"), F.lit("").alias("detail")).distinct()
    name = F.col("subject")
    root = _violations(placed.where("depth = 1").select("library", F.col("path").alias("subject")), ("error", "reference-at-root", name.rlike(REFERENCE), None), ("warning", "unexpected-root-file", ~name.rlike(REFERENCE) & (name != ROUTER), None))
    inside = _violations(placed.where((F.col("depth") == 2) & (F.col("top") == FOLDER)).select("library", F.col("second").alias("subject")), ("warning", "unexpected-reference-file", ~name.rlike(REFERENCE) & (name != INDEX), None))
    whole = placed.groupBy("library").agg(F.bool_or(F.col("path") == ROUTER).alias("router"), F.bool_or((F.col("depth") > 1) & (F.col("top") == FOLDER)).alias("folder"), F.bool_or((F.col("depth") == 2) & (F.col("top") == FOLDER) & F.col("second").rlike(REFERENCE)).alias("refs"))
    missing = _violations(whole.withColumn("subject", F.lit(ROUTER)), ("error", "router-missing", ~F.col("router"), None), ("error", "folder-missing", ~F.col("folder"), None), ("error", "no-references", F.col("folder") & ~F.col("refs"), None))
    return folders.unionByName(nested).unionByName(root).unionByName(inside).unionByName(missing)


def frontmatter_violations(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("path") == ROUTER).select("library", F.lit(ROUTER).alias("subject"), frontmatter(F.col("text")).alias("fm"))
    rows = rows.withColumns({"name": strip_chars(strip(_found(F.col("fm"), r"(?dm)^name:\s*(.+)$")), "\"'"), "about": strip(_found(F.col("fm"), r"(?dms)^description:\s*(.+)$"))})
    has, name, about = F.col("fm").isNotNull(), F.col("name"), F.col("about")
    reserved = F.array_max(F.array(*[F.contains(name, F.lit(w)) for w in RESERVED]))
    return _violations(
        rows, ("error", "no-frontmatter", ~has, None), ("error", "no-name", has & name.isNull(), None), ("error", "bad-name", ~name.rlike(rf"\A{SLUG}\z"), name),
        ("error", "reserved-name", reserved, name), ("error", "no-description", has & about.isNull(), None), ("error", "short-description", F.length(about) < MIN_DESCRIPTION, F.length(about)),
    )


def router_links(files: DataFrame) -> DataFrame:
    """(library, target) of the local links of each router's table of books; placeholders are among them."""
    router = files.where(F.col("path") == ROUTER).select("library", find_section(sections(F.col("text")), "which book").alias("s")).where("s is not null")
    links = router.select("library", F.explode(F.regexp_extract_all("s.body", F.lit(MD_LINK), F.lit(1))).alias("target"))
    return links.where(~F.col("target").rlike(r"\A(?:https?://|mailto:|#)"))


def router_violations(files: DataFrame) -> DataFrame:
    router = files.where(F.col("path") == ROUTER)
    none = _violations(router.select("library", F.lit(ROUTER).alias("subject"), find_section(sections(F.col("text")), "which book").alias("s")), ("error", "no-router-section", F.col("s").isNull(), None))
    links = router_links(files)
    holder = _violations(links.select("library", F.col("target").alias("subject")), ("error", "placeholder-link", F.col("subject").rlike("[{}<>]"), None))
    local = links.where(~F.col("target").rlike("[{}<>]")).select("library", F.split("target", "#")[0].alias("path")).distinct()
    paths = files.select("library", "path").hint("merge")
    lost = local.join(paths, ["library", "path"], "left_anti")
    hint = lost.join(paths.select("library", F.col("path").alias("there")), (lost["library"] == paths["library"]) & (F.col("there") == F.concat(F.lit(f"{FOLDER}/"), lost["path"])), "left").select(lost["library"], lost["path"].alias("subject"), "there")
    dangling = _violations(hint, ("error", "dangling-link", F.lit(True), F.coalesce("there", F.lit(""))))
    named = router.select("library").join(none.select("library"), "library", "left_anti")
    orphans = _references(files).join(named, "library", "left_semi").select("library", "path").join(local.hint("merge"), ["library", "path"], "left_anti")
    return none.unionByName(holder).unionByName(dangling).unionByName(_violations(orphans.select("library", F.col("path").alias("subject")), ("error", "unreachable", F.lit(True), None)))


def topic_index(files: DataFrame) -> DataFrame:
    """(library, spilled, populated, entry): a row for each entry of the topic index, wherever it is."""
    router = files.where(F.col("path") == ROUTER).select("library", "text", find_section(sections(F.col("text")), "topic index").alias("s"))
    spilled = files.where(F.col("path") == f"{FOLDER}/{INDEX}").select("library", F.col("text").alias("index"))
    both = router.join(spilled, "library", "left")
    return both.select("library", F.col("index").isNotNull().alias("spilled"), F.size(index_entries(F.coalesce("s.body", F.lit("")))).alias("own"), F.contains("text", F.lit(INDEX)).alias("pointed"), index_entries(F.coalesce("index", "s.body", F.lit(""))).alias("entries"))


def index_violations(files: DataFrame) -> DataFrame:
    index = topic_index(files)
    whole = _violations(
        index.withColumn("subject", F.lit(INDEX)), ("error", "index-not-spilled", F.col("spilled") & (F.col("own") > 1), F.col("own")), ("error", "index-unreachable", F.col("spilled") & ~F.col("pointed"), None),
        ("warning", "index-too-long", F.size("entries") > MAX_ENTRIES, F.size("entries")),
    )
    entry = index.select("library", F.explode("entries").alias("e"))
    few = _violations(entry.select("library", F.col("e.term").alias("subject"), F.size("e.books").alias("n")), ("error", "index-few-books", F.col("n") < MIN_BOOKS, F.col("n")))
    named = entry.select("library", F.col("e.term").alias("subject"), F.explode("e.books").alias("slug")).where("slug <> ''")
    unknown = named.join(_references(files).select("library", "slug").hint("merge"), ["library", "slug"], "left_anti")
    return whole.unionByName(few).unionByName(_violations(unknown, ("warning", "index-unknown-book", F.lit(True), F.col("slug"))))


def master_violations(files: DataFrame) -> DataFrame:
    """The router's size against its scaling budget, with the entries of the topic index."""
    entries = topic_index(files).select("library", F.size("entries").alias("entries"))
    rows = routers(files).join(entries, "library").withColumn("budget", master_budget(F.col("books"), F.col("capabilities"), F.col("entries"))).withColumn("subject", F.lit(ROUTER))
    over = F.col("tokens") > MASTER_STOP
    return _violations(rows, ("error", "master-over-stop", over, F.col("tokens")), ("warning", "master-over-budget", ~over & (F.col("tokens") > F.bround(F.col("budget") * (1 + TOLERANCE))), F.col("tokens")))


def reference_violations(files: DataFrame) -> DataFrame:
    text = F.col("text")
    master = once(files.where(F.col("path") == ROUTER), ["library"], fallback=declared_depth(text, F.lit("study")))
    rows = once(
        _references(files), ["library", "name"], own=declared_depth(text, F.lit(None).cast("string")), type=book_type(text), tokens=estimate_tokens(text), sections=declared_sections(text), titles=titles(text), titled=text.rlike(r"\A#\s+\S"),
    ).join(master.hint("merge"), "library")
    rows = rows.withColumn("depth", F.coalesce("own", "fallback"))
    rows = rows.withColumns({"budget": reference_budget(F.col("sections"), F.col("depth"), F.col("type")), "cap": reference_cap(F.col("depth"), F.col("type"))})
    rows = rows.withColumn("worked", F.size(F.filter("titles", lambda t: F.contains(t, F.lit("worked example"))))).withColumn("subject", F.col("name"))
    over = F.col("tokens") > F.col("cap")

    def lacks(title: str) -> Column:
        return ~F.exists("titles", lambda t: F.contains(t, F.lit(title.lower())))

    return _violations(
        rows, ("error", "over-cap", over, F.col("tokens")), ("warning", "no-sections", ~over & F.col("budget").isNull(), None), ("warning", "over-budget", ~over & (F.col("tokens") > F.bround(F.col("budget") * (1 + TOLERANCE))), F.col("tokens")),
        ("error", "no-title", ~F.col("titled"), None), *[("error", "missing-section", lacks(t), F.lit(t)) for t in REQUIRED_SECTIONS], ("warning", "no-decision-rules", lacks("decision rules"), None),
        ("error", "worked-example-in-reference", (F.col("depth") == "reference") & (F.col("worked") > 0), None), ("error", "many-worked-examples", F.col("worked") > 1, F.col("worked")), ("warning", "no-worked-example", (F.col("depth") == "study") & (F.col("worked") == 0), None),
    )


CHECKS = (layout_violations, frontmatter_violations, router_violations, index_violations, master_violations, reference_violations)


def validate(files: DataFrame) -> DataFrame:
    """All violations (library, severity, check, subject, detail); a library without a router has only those of its layout."""
    out = None
    for check in CHECKS:
        found = check(files).select(*VIOLATION)
        out = found if out is None else out.unionByName(found)
    return out


def audit(skills: DataFrame, lens: str) -> DataFrame:
    """Violations of skill files (library, text, optional directory) under one host's rules."""
    rows = skills.withColumns({"subject": F.lit(ROUTER), "block": frontmatter(F.col("text"))}).withColumn("fm", fields(F.col("block")))
    rows = rows.withColumns({"name": strip_chars(F.coalesce(F.try_element_at("fm", F.lit("name")), F.lit("")), "\"'"), "about": strip_chars(F.coalesce(F.try_element_at("fm", F.lit("description")), F.lit("")), "\"'"), "body": estimate_tokens(strip_frontmatter(F.col("text")))})
    has, name, about = F.col("block").isNotNull(), F.col("name"), F.col("about")
    named = has & (name != "")
    reserved = F.array_max(F.array(*[F.contains(F.lower(name), F.lit(w)) for w in RESERVED]))
    checks = [
        ("error", "no-frontmatter", ~has, None), ("error", "no-name", has & (name == ""), None), ("error", "bad-name", named & ~name.rlike(rf"\A{SLUG}\z"), name), ("error", "long-name", named & (F.length(name) > MAX_NAME), F.length(name)),
        ("error", "reserved-name", named & reserved, name), ("error", "no-description", has & (about == ""), None), ("error", "short-description", has & (about != "") & (F.length(about) < MIN_DESCRIPTION), F.length(about)),
        ("warning", "long-description", has & (F.length(about) > MAX_DESCRIPTION), F.length(about)), ("warning", "long-body", has & (F.col("body") > SOFT_BODY), F.col("body")), ("warning", "no-heading", has & ~F.col("text").rlike(r"(?m)^#\s+\S"), None),
    ]
    if "directory" in skills.columns:
        checks.append(("warning", "name-differs-from-directory", named & (F.col("directory") != "") & (name != F.col("directory")), F.col("directory")))
    keys = rows.where(has).select("library", F.col("subject"), F.explode(F.map_keys("fm")).alias("key")).where(~F.col("key").isin(*LENSES[lens]))
    return _violations(rows, *checks).unionByName(_violations(keys, ("warning", "unknown-key", F.lit(True), F.col("key"))))


def token_gate(files: DataFrame, budget: int, body_only: bool = False, text: str = "text") -> DataFrame:
    """``files`` with tokens and over (more than ``budget``)."""
    value = strip_frontmatter(F.col(text)) if body_only else F.col(text)
    return files.withColumn("tokens", estimate_tokens(F.coalesce(value, F.lit("")))).withColumn("over", F.col("tokens") > budget)


def gate_totals(gated: DataFrame) -> DataFrame:
    """(files, over, total_tokens, passes) of a token gate's rows."""
    return gated.agg(F.count("*").alias("files"), F.count_if("over").alias("over"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), (~F.coalesce(F.bool_or("over"), F.lit(False))).alias("passes"))


def reports(violations: DataFrame) -> DataFrame:
    """(library, errors, warnings, passes, report): the violations of each library as one JSON array, ordered."""
    item = F.struct("severity", "check", "subject", "detail")
    counts = [F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"))]
    out = violations.groupBy("library").agg(*counts, F.to_json(F.array_sort(F.collect_list(item))).alias("report"))
    return out.select("library", "errors", "warnings", (F.col("errors") == 0).alias("passes"), "report")


def tripwires(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, code_lines, table_lines, total_lines): the signals of technical text, on text that isn't sanitised yet."""
    counted = df.select(*keys, split_lines(F.coalesce(F.col(text), F.lit(""))).alias("__lines"))
    return counted.select(*keys, F.size(F.filter("__lines", lambda x: x.rlike(r"\A {4,}"))).alias("code_lines"), F.size(F.filter("__lines", lambda x: x.rlike(r"\A\s*\|.*\|.*\|"))).alias("table_lines"), F.size("__lines").alias("total_lines"))


__all__ = ["CAP_SECTIONS", "CHECKS", "audit", "budget_report", "density", "reference_files", "routers", "token_gate", "topic_index", "tripwires", "validate"]
