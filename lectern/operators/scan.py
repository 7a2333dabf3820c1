"""Scan of text for instructions aimed at its reader: one finding for each line and rule.

A document none of whose text fits any rule is passed over as a whole; only the others are taken
apart into lines. Rules are a registry of (name, severity, pattern, reason, needs); patterns are put
together from word lists. A rule's needs are pieces that whatever fits its pattern holds, one of each
group: a text without them is told apart by a search for plain strings, and no pattern is tried on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import excerpt, let, link_host, split_lines
from lectern.operators.sanitize import INVISIBLE

SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def any_of(*words: str) -> str:
    return f"(?:{'|'.join(words)})"


def word(*words: str) -> str:
    return rf"(?U:\b){any_of(*words)}(?U:\b)"


def gap(most: int, stops: str = r"\n.") -> str:
    return f"[^{stops}]{{0,{most}}}"


@dataclass(frozen=True)
class ScanRule:
    name: str
    severity: str
    pattern: str
    why: str
    needs: tuple[tuple[str, ...], ...] = ()  # in lower case


_B, _WEB, _BLANK = r"(?U:\b)", "https?://", r"(?U:\s)"
RULES: tuple[ScanRule, ...] = (
    ScanRule("instruction-override", "HIGH", word("disregard", "forget", "ignore") + gap(40) + word("all", "above", "earlier", "previous", "prior") + gap(20) + _B + any_of("direction", "instruction", "prompt", "rule") + "s?" + _B, "calls off the reader's instructions", (("disregard", "forget", "ignore"), ("direction", "instruction", "prompt", "rule"))),
    ScanRule("identity-override", "HIGH", any_of(f"{_B}you are " + any_of("actually", "now", "really") + _B, f"{_B}from now on,? you{_B}", f"{_B}act as if you{_B}"), "gives the reader another identity", (("you are ", "from now on", "act as if you"),)),
    ScanRule("system-prompt-reference", "HIGH", any_of(f"{_B}system prompt{_B}", "</?" + any_of("assistant", "human", "system", "user") + ">", r"\[/?INST\]"), "forges or names parts of a conversation", (("system prompt", "assistant>", "human>", "system>", "user>", "inst]"),)),
    ScanRule("concealment", "HIGH", word("do not", "don't", "never") + gap(30) + word("inform", "mention", "reveal", "show", "tell") + gap(20) + f"{_B}(?:the )?" + any_of("human", "owner", "user") + _B, "asks to keep something from the user", (("human", "owner", "user"), ("do not", "don't", "never"))),
    ScanRule("credential-solicitation", "HIGH", word("enter", "export", "output", "paste", "print", "provide", "reveal", "send") + gap(40, r"\n") + any_of(rf"{_B}api[-_ ]?key{_B}", rf"\.env{_B}", f"{_B}credential", word("password", "private key", "secret", "token")), "asks for credentials", (("key", ".env", "credential", "password", "secret", "token"), ("enter", "export", "output", "paste", "print", "provide", "reveal", "send"))),
    ScanRule("shell-execution", "HIGH", any_of(word("curl", "nc", "netcat", "wget") + gap(80, r"\n") + _WEB, rf"{_B}chmod{_BLANK}+\+x{_B}", rf"{_B}rm{_BLANK}+-rf{_B}", word("bash", "sh").removesuffix(_B) + rf"{_BLANK}+-c{_B}", rf"\|{_BLANK}*" + any_of("bash", "sh") + _B), "holds a command that downloads or destroys", (("http", "chmod", "-rf", "-c", "|"),)),
    ScanRule("exfiltration", "HIGH", any_of(word("forward", "post", "report", "send", "upload") + gap(40) + word("to") + gap(20) + _WEB, _WEB + r"[^)\s]{0,120}[&?]" + any_of("body", "content", "data", "payload", "q", "text") + "="), "sends content elsewhere", (("http",),)),
    ScanRule("authority-claim", "MEDIUM", any_of(word("approved by", "authori[sz]ed by", "mandated by", "on behalf of") + gap(30) + word("admin", "administrator", "anthropic", "google", "openai", "security team", "the system"), f"{_B}as " + any_of("the", "your") + " " + any_of("administrator", "developer", "supervisor") + _B), "claims an authority that text cannot have", (("ed by", "on behalf of", "administrator", "developer", "supervisor"), ("admin", "anthropic", "google", "openai", "security team", "the system", "developer", "supervisor"))),
    ScanRule("tool-directive", "MEDIUM", word("call", "execute", "invoke", "run") + gap(30) + _B + any_of("the following", "this") + " " + any_of("code", "command", "script", "tool") + _B, "tells the reader to execute something", (("the following ", "this "), ("code", "command", "script", "tool"))),
    ScanRule("urgency-pressure", "MEDIUM", word("before (?:you )?(?:continue|respond)", "immediately", "right now", "urgent", "without delay") + gap(40) + word("have to", "must", "need to", "should"), "presses for haste", (("immediately", "right now", "urgent", "without delay", "before "), ("have to", "must", "need to", "should"))),
    ScanRule("file-access-directive", "MEDIUM", word("access", "cat", "list", "open", "read") + gap(30) + any_of(r"\.aws", r"\.git/config", r"\.ssh", r"/etc/\w+", "id_rsa", r"~/\.\w+"), "points at private files", ((".aws", ".git/config", ".ssh", "/etc/", "id_rsa", "~/."),)),
    ScanRule("invisible-characters", "LOW", INVISIBLE, "characters that no reviewer sees"),
)
LINK = rf"\[[^\]]*\]\(({_WEB}[^)]+)\)"
ALLOWED_HOSTS = ("archive.org", "doi.org", "en.wikipedia.org", "github.com", "web.archive.org", "www.doi.org", "www.github.com")
LINK_WHY = "a link to a host that isn't on the list"


FOLDS = {"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"}


def folded(text: Column) -> Column:
    """The text in lower case, with the four letters that a pattern without regard to case takes for ASCII ones."""
    plain = text
    for letter, ascii_ in FOLDS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(plain))


def suspect(text: Column) -> Column:
    """Whether any rule's pattern, or a link, is in the text."""
    def held(low: Column, group: tuple[str, ...]) -> Column:
        return reduce(or_, [F.contains(low, F.lit(x)) for x in group])

    def any_rule(low: Column) -> Column:
        fits = [reduce(and_, [*[held(low, g) for g in r.needs], text.rlike(_flagged(r))]) for r in RULES if r.needs]
        return reduce(or_, fits, F.contains(low, F.lit("](http")) & text.rlike(LINK))

    rest = [text.rlike(_flagged(r)) for r in RULES if not r.needs]  # characters beyond ASCII
    return let(folded(text), any_rule) | ((F.octet_length(text) != F.length(text)) & reduce(or_, rest))


def _flagged(rule: ScanRule) -> str:
    return rule.pattern if rule.name == "invisible-characters" else f"(?iu){rule.pattern}"


def line_findings(line: Column) -> Column:
    """array<struct(rule_no, severity, rule, why, excerpt)> of a line."""
    hits = [F.when(line.rlike(_flagged(r)), F.struct(F.lit(i).alias("rule_no"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule"), F.lit(r.why).alias("why"), excerpt(line).alias("excerpt"))) for i, r in enumerate(RULES)]
    links = F.filter(F.regexp_extract_all(line, F.lit(LINK), F.lit(1)), lambda u: ~link_host(u).isin(*ALLOWED_HOSTS))
    outside = F.transform(links, lambda u: F.struct(F.lit(len(RULES)).alias("rule_no"), F.lit("LOW").alias("severity"), F.lit("external-link").alias("rule"), F.lit(LINK_WHY).alias("why"), excerpt(u).alias("excerpt")))
    return F.concat(F.array_compact(F.array(*hits)), outside)


def scan(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, severity, rule, why, excerpt, rule_no) of every finding."""
    value = F.col(text)
    rows = df.where(suspect(value)).select(*keys, F.posexplode(split_lines(value)).alias("pos", "__line"))
    found = rows.select(*keys, (F.col("pos") + 1).alias("line"), F.explode(line_findings(F.col("__line"))).alias("f"))
    return found.select(*keys, "line", "f.severity", "f.rule", "f.why", "f.excerpt", "f.rule_no")


def unreadable(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Findings for files that couldn't be read (an ``error`` column)."""
    return parsed.where("error is not null").select(*keys, F.lit(0).alias("line"), F.lit("LOW").alias("severity"), F.lit("unreadable").alias("rule"), F.col("error").alias("why"), F.lit("").alias("excerpt"), F.lit(-1).alias("rule_no"))


def scan_parsed(parsed: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Findings of the files that could be read, and one for each that couldn't be."""
    return scan(parsed.where("error is null"), keys, text).unionByName(unreadable(parsed, keys))


def outcomes(findings: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, findings, any_high, passes): ``strict`` lets nothing with a HIGH finding pass."""
    out = findings.groupBy(*keys).agg(F.count("*").alias("findings"), F.bool_or(F.col("severity") == "HIGH").alias("any_high"))
    return out.withColumn("passes", ~F.col("any_high") if strict else F.lit(True))


def ranked(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``findings`` with ``place``: its place among those of its keys, by severity, line and rule."""
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "line", "rule_no", "excerpt")
    return findings.withColumn("place", F.row_number().over(order))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def ordered(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), *keys, "line", "rule_no")


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, findings): all three severities, also those without findings."""
    spark = findings.sparkSession
    counts = findings.groupBy("severity").agg(F.count("*").alias("findings"))
    return spark.createDataFrame([(s,) for s in SEVERITIES], "severity string").join(counts, "severity", "left").select("severity", F.coalesce("findings", F.lit(0)).alias("findings"))
