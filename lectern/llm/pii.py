"""Personal data by weak-supervision aggregation.

Loose patterns propose candidate spans: mails, phones, cards, addresses of machines, social security
and account numbers, secrets (key words, tokens, private key blocks), and by their context birth
dates, names and street addresses. Seven labelers, regular expressions, checksums, gazetteers and
context words, each vote private (+1), harmless (-1) or abstain (0). The votes of **all** candidates
of the corpus are counted by pattern; expectation-maximisation on the counts estimates each
labeler's reliability for each kind (Dawid-Skene with two latent classes; who abstains says nothing;
prior beliefs weigh as much as ``PRIOR`` candidates) and a posterior per pattern. A logistic span
classifier is then trained on the counts, with the posteriors as soft labels and votes, kind and
shape as features, and decides every span. Only the count table, whose size is bounded by the
discrete features, ever reaches the driver.

Defined cases: a null or empty text has no spans and stays as it is; texts of any length are
scanned whole; overlapping proposals keep the one that begins first, then the longer one; a null
doc_id is carried along; repeated rows give repeated spans; without candidates no model is
needed and nothing is found; columns other than doc_id, text and n_chars are never touched.
Redaction writes the kind in angle brackets and renews an n_chars column that held the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._vec import releasing

THRESHOLD, ROUNDS = 0.5, 100
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "secret", "birth", "person", "address")
LABELERS = ("format", "checksum", "gazetteer", "cue", "anti_cue", "boundary", "variety")
STRICT_LABELERS = ("format", "checksum")
PRIOR, STRICT_BELIEF, BELIEF = 4.0, 0.95, 0.8  # what is believed of a labeler counts as this many candidates
WINDOW = 40  # characters of context on the left

_MONTH = r"(?:jan|feb|m[aä]r|apr|abr|ma[iy]|jun|jul|aug|ago|sep|o[ck]t|nov|de[cz]|ene|juin|juil|août|avr|fév|déc)\w*\.?"
_DATE = (
    rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|\d{{1,2}}\.?\ (?:de\ )?(?i:{_MONTH})\ (?:de\ )?\d{{4}}"
    rf"|(?i:{_MONTH})\ \d{{1,2}},?\ \d{{4}})(?!\d)"
)
_BORN = r"(?i:born|date\ of\ birth|birth\ ?date|birthday|d\.?o\.?b\.?|geboren|geb\.|geburtsdatum|n[ée]e?|date\ de\ naissance|nacid[oa]|fecha\ de\ nacimiento)"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][\w'’]+"
_NAME = rf"{_CAPITAL}(?:(?:\ |-|\ (?:de|del|la|van|von|der)\ ){_CAPITAL}){{0,3}}"
_TITLED = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.?\ "
_NAMED = r"(?i:(?:full|first|last|given|family|customer|patient|employee|user)[\ _-]?name|name|surname|patient|vorname|nachname|nombre|apellidos?|nom|prénom)[\"']?\ ?[:=]\ ?[\"']?"
_WAY = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Way|Terrace)"
_STREET = (
    rf"\d{{1,5}}[A-Za-z]?\ (?:{_CAPITAL}\ ){{1,3}}{_WAY}(?!\w)|[A-ZÄÖÜ]\w+(?:straße|strasse|str\.|weg|platz|allee|gasse)\ \d{{1,4}}[a-z]?(?!\w)"
    rf"|\d{{1,4}}(?:\ (?:bis|ter))?,?\ (?:rue|avenue|boulevard|place|allée|chemin|impasse)\ (?:de\ la\ |de\ |du\ |des\ |l['’])?{_CAPITAL}(?:\ {_CAPITAL})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo)\ (?:de\ la\ |de\ |del\ )?{_CAPITAL}(?:\ {_CAPITAL})?,?\ \d{{1,4}}(?!\d)"
)
#: Key words of secrets, and what secrets begin with; no repeat has an upper bound, so that no tail stays behind.
_KEYWORD = r"(?=[PpSsTtAaCc])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
_PREFIXED = r"(?:(?=[GgSsXx])(?i:gh[pousr]_|github_pat_|glpat-|sk-|xox[abp]-)[\w-]{16,}+)"
_SECRET = rf"""{_KEYWORD}["']?\s{{0,3}}[=:]\s{{0,3}}["']?(?!(?i:bearer)\s)[^\s"',;]{{6,}}+|(?=[Bb])(?i:bearer)\ +[\w.~+/=-]{{16,}}+|eyJ[\w-]{{8,}}+\.[\w-]{{8,}}+(?:\.[\w-]*+)?
        |(?=[A-Z]{{2}})[A-Z0-9]{{16,}}+(?![A-Za-z0-9])|{_PREFIXED}|[0-9A-Fa-f]{{32,}}+(?![0-9A-Za-z])"""
_BLOCK = r"-----BEGIN\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY-----(?:(?s:.*?)-----END\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY-----|[\sA-Za-z0-9+/=]*+)"
_IPV6 = r"""(?=[0-9A-Fa-f:]{2,39})(?:(?:[0-9A-Fa-f]{1,4}:){6,7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}:){0,6})
        (?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{1,4})?"""
_PHONE = r"""\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}(?!\d)
        |0\d(?:[ .-]\d{2}){4}(?!\d)|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ ./-])\d{3,4}[ .-]?\d{3,4}(?![ ./-]?\d)
        |(?:\+|00)\d(?:(?![ ]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|[ ]\d{1,3}(?:\.\d{1,3}){3})[ ./-]?\(?\d\)?){6,14}(?!\d)
        |0\d{2,4}(?:[ ]?[/-][ ]?|[ ])(?:\d{5,8}(?:-\d{1,4})?|\d{2,4}(?:[ -]\d{2,4}){1,3})(?!\d)|[6-9]\d{2}(?:[ .-]\d{2}){3}(?!\d)
        |[89]\d[ .-]\d{3}(?:[ .-]\d{2}){2}(?!\d)|(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ ./-])\d{3,4}[ .-]?\d{3,4}(?!\d)"""
#: Where a kind is proposed by its context, the group with ``_at`` holds the span itself.
_PROPOSALS = re.compile(
    rf"""(?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)*)
    |(?P<birth>(?<!\w)(?=[BbDdGgNnFf]){_BORN}\W{{1,3}}(?:(?:on|am|le|el|is)\ )?(?P<birth_at>{_DATE}))
    |(?P<person>(?<!\w)(?:(?=[MDPHFS]){_TITLED}|(?=[FfLlGgCcPpEeUuNnSsVvAa]){_NAMED})(?P<person_at>{_NAME}))
    |(?P<address>(?<![\w.])(?:{_STREET}))
    |(?P<iban>(?<![A-Za-z0-9])(?![0-9A-F]{{32}})[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9])(?:{_SECRET})|{_BLOCK})
    |(?P<card>(?<![\d.])(?:\d{{13,19}}|\d{{4}}(?P<sep>[ -])\d{{4}}(?P=sep)\d{{4}}(?P=sep)\d{{1,7}})(?!\d))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<ip>(?<![\d.])(?!0\d(?:\.\d{{2}}){{4}}(?!\d))\d{{1,3}}(?:\.\d{{1,3}}){{1,5}}(?!\d)|(?<![\w:.]){_IPV6}(?![\w:]))
    |(?P<phone>(?<![\w.])(?:{_PHONE})|\+\d{{7,15}}(?!\d))""",
    re.VERBOSE,
)
#: Every proposal has one of these.
_MAYBE = (
    r"[0-9@]|::|(?:[A-Fa-f]{1,4}:){6}|[A-Z]{16}|-----BEGIN|eyJ|(?i:pass|pwd|secret|token|key|auth|credential|bearer|gh[pousr]_|github_|glpat|sk-|xox[abp]-|[a-f]{32})"
    r"|(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.? |(?i:name|patient|nombre|apellidos?|nom)[\"']? ?[:=]"
)
_STRICT = {
    "email": r"[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{9,15}|(?:\+|00)\d{1,3}(?:[ ./-]?\(?\d{2,4}\)?){2,5}"
    r"|(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d|0\d)(?:[ .-]?\d{2}){4}|(?:\+|00)\d{1,3}[ .-]?\(0\)(?:[ ./-]?\d{2,4}){2,5}"
    r"|0\d{2,4}(?: ?[/-] ?| )(?:\d{5,8}(?:-\d{1,4})?|\d{2,4}(?:[ -]\d{2,4}){1,3})|[6-9]\d{2}(?:[ .-]\d{2}){3}|[89]\d[ .-]\d{3}(?:[ .-]\d{2}){2}",
    "card": r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*",
    "ssn": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?i:gh[pousr]_|github_pat_|glpat-|sk-|xox[abp]-)[\w-]{16,}|[0-9A-Fa-f]{32,}|eyJ[\w.-]+|(?i:bearer) .*|(?s:-----BEGIN.*)|.*?[=:].*",
    "birth": _DATE.replace("\\ ", " "),
    "person": _NAME.replace("\\ ", " "),
    "address": _STREET.replace("\\ ", " "),
}
_STRICT = {k: re.compile(v) for k, v in _STRICT.items()}
_CUES = {
    "email": r"mail|contact|write|address|correo|courriel",
    "phone": r"call|phone|tel|fax|mobile|dial|ruf|llam|appel",
    "card": r"card|visa|credit|pay|karte|carte|tarjeta",
    "ip": r"\bip\b|host|server|address|client|from",
    "ssn": r"ssn|social",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "secret": r"password|passwd|pwd|passphrase|secret|token|key|auth|credential|bearer",
    "birth": _BORN.replace("\\ ", " "),
    "person": r"name|nombre|nom|apellido|patient|(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.? $",
    "address": r"address|adresse|direcci|lives|wohn|habite|vive|ship|deliver",
}
_CUES = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_ANTI = re.compile(r"(?:version|\bv|release|licen[sc]e|licensed|section|chapter|figure|fig\.|page|isbn|doi|cc by\S*|\bby-\S*|python|no\.|file|host|user|domain)\W{0,3}$", re.I)
_ISSUER = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|(?:6011|64[4-9]\d|65\d\d)\d{12}|35\d{14}")
_TLDS = frozenset("com org net edu gov mil io de fr es uk us eu co info biz me dev app ch at it nl be pt pl se no fi dk ca au jp cn in br mx ar".split())
_IBAN = frozenset("AD AE AL AT BA BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK SM TR".split())
_FIRST = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria "
    "peter paul hans klaus jürgen wolfgang andreas stefan ursula monika petra sabine pierre jean michel philippe marie nathalie isabelle sophie josé antonio manuel "
    "francisco juan carmen lucía ana laura alice bob daniel mark emma olivia noah liam lukas leon mia hugo louis chloé pablo sofía".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _ipv6(x: str) -> tuple[int, int]:
    """Votes of the checksum and the gazetteer: is it an address, and one of a host?"""
    try:
        a = ip_address(x)
    except ValueError:
        return -1, -1
    a = a.ipv4_mapped or a
    return 1, -1 if a.is_loopback or a.is_unspecified or a.is_multicast or a.version == 6 and a.is_reserved else 0


def _entropy(x: str) -> float:
    n = np.unique(np.frombuffer(x.encode(), np.uint8), return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(kind: str, span: str, left: str, right: str) -> tuple[int, ...]:
    """One vote of each of ``LABELERS`` on a candidate between its contexts."""
    body = span.split("=", 1)[-1].split(":", 1)[-1].strip("\"' ") if kind == "secret" and not span.startswith("-----") else span
    fmt = 1 if _STRICT[kind].fullmatch(span) else -1
    if kind in ("card", "iban", "ip"):
        fmt = min(fmt, 0)  # what the checksum, the range or the gazetteer says isn't said twice
    check = gaz = 0
    if kind == "card":
        digits = re.sub(r"\D", "", span)
        check = 1 if luhn(digits) else -1
        gaz = 0 if _ISSUER.fullmatch(digits) else -1  # two numbers of five begin like some issuer's
    elif kind == "ip" and ":" in span:
        check, gaz = _ipv6(span)
    elif kind == "ip":
        parts = [int(x) for x in span.split(".")]
        check = 1 if len(parts) == 4 and max(parts) < 256 else -1
        gaz = -1 if len(parts) < 4 or parts[0] in (0, 127, 255) else 0
    elif kind == "email":
        gaz = 1 if span.rpartition(".")[2].lower() in _TLDS else -1
    elif kind == "phone":
        n = len(re.sub(r"\D", "", span))
        check = 0 if 9 <= n <= 15 else -1
        gaz = 1 if span[0] in "+(" else 0
    elif kind == "iban":
        check = 1 if _iban_ok(span) else -1
        gaz = 1 if span[:2] in _IBAN else -1
    elif kind == "birth":
        check = 1 if all(0 < int(x) <= 31 or 1900 <= int(x) <= 2100 for x in re.findall(r"\d+", span)) else -1
    elif kind == "person":
        gaz = 1 if span.split()[0].lower() in _FIRST else 0
    elif kind == "secret":
        word = body == span and not re.search(r"[\d_-]", span)  # capitals only
        check = 1 if _entropy(body) >= 2.5 and len(body) >= 8 and not word else -1
        gaz = 1 if re.match(r"AKIA|ASIA|-----BEGIN|eyJ|(?i:gh[pousr]_|github_pat_|glpat-|sk-|xox|bearer)", body) else 0
    cue = 1 if _CUES[kind].search(left) or (kind == "secret" and _CUES[kind].search(span)) else 0
    anti = -1 if _ANTI.search(left) else 0
    before = not left or left[-1].isspace() or left[-1] in "\"'(<[:,;="
    after = not right or right[0].isspace() or right[0] in "\"')>],.;:!?"
    return fmt, check, gaz, cue, anti, 1 if before and after else -1, 1 if len(set(body)) >= 5 else -1


def shape(kind: str, span: str) -> tuple[int, int]:
    """(length class, share of digits in quarters) of a candidate."""
    return min(len(span) // 4, 12), int(4 * sum(c.isdigit() for c in span) / len(span))


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
    """(start, end, kind, features: votes and shape) of each proposal, in order and without overlaps."""
    for m in _PROPOSALS.finditer(text):
        kind = m.lastgroup
        a, b = m.span(f"{kind}_at" if kind in ("birth", "person") else kind)
        span = text[a:b]
        yield a, b, kind, (*votes(kind, span, text[max(0, a - WINDOW) : a], text[b : b + 1]), *shape(kind, span))


def _scan(col: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, str, tuple[int, ...]]]]]:
    """(row, text, candidates) of the rows that have any."""
    maybe = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(col, _MAYBE), False)))
    for r in maybe.tolist():
        text = col[r].as_py()
        if found := list(candidates(text)):
            yield r, text, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    count: Counter = Counter()
    for b in batches:
        for _, _, found in _scan(b.column("text")):
            count.update((kind, f) for _, _, kind, f in found)
    if count:
        kinds, feats = zip(*count, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([list(f) for f in feats], pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], ["kind", "features", "n"])


@dataclass
class SpanModel:
    """Weights of the final classifier, and the labelers' estimated reliabilities for inspection."""

    weights: np.ndarray
    reliability: dict[str, tuple[float, float]]

    def score(self, kind: str, feats: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(design([kind], np.array([feats])) @ self.weights, -500, 500)))[0])


def design(kinds: list[str], feats: np.ndarray) -> np.ndarray:
    """Feature matrix: bias, kinds, each vote as two flags, length and digit share."""
    v = feats[:, : len(LABELERS)]
    kind = np.array([[k == x for x in KINDS] for k in kinds], float)
    return np.hstack([np.ones((len(v), 1)), kind, v == 1, v == -1, feats[:, [-2]] / 12, feats[:, [-1]] / 4])


def em(kinds: list[str], v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """(posterior of each vote pattern, (P(+1 | private), P(-1 | harmless)) of each labeler).

    Reliabilities are counted by kind and drawn towards those over all kinds, which in turn are drawn
    towards what is believed of a labeler, each with the weight of ``PRIOR`` candidates. So a few dozen
    candidates outweigh any belief.
    """
    vals = np.stack([v == -1, v == 1], 2).astype(float)  # pattern x labeler x vote; who abstains says nothing
    hard = np.isin(LABELERS, STRICT_LABELERS)
    post = 1 / (1 + np.exp(-1.5 * (v.sum(1) - 2 * (v[:, hard] == -1).sum(1))))  # to begin with, a majority in which strict labelers' noes count thrice
    kind = np.array([KINDS.index(k) for k in kinds])
    size = np.bincount(kind, weights=n, minlength=len(KINDS))
    right = np.where(hard, STRICT_BELIEF, BELIEF)[:, None]
    belief = (PRIOR * np.hstack([1 - right, right]), PRIOR * np.hstack([right, 1 - right]))
    where = np.eye(len(KINDS))[kind]  # pattern x kind
    whole: list[np.ndarray] = []
    for _ in range(rounds):
        like, whole = np.zeros((len(v), 2)), []
        for y, q in ((0, post * n), (1, (1 - post) * n)):
            t = np.einsum("p,pk,plv->klv", q, where, vals)
            overall = t.sum(0) + belief[y]
            whole.append(overall / overall.sum(1, keepdims=True))
            t = t + PRIOR * whole[y]
            like[:, y] = np.einsum("plv,plv->p", vals, np.log(t / t.sum(2, keepdims=True))[kind])
        prior = (where.T @ (post * n) + 1) / (size + 2)
        z = like[:, 0] - like[:, 1] + np.log(prior / (1 - prior))[kind]
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return post, {name: (float(whole[0][i, 1]), float(whole[1][i, 0])) for i, name in enumerate(LABELERS)}


def train(docs: DataFrame) -> SpanModel | None:
    """Span classifier from the votes on all candidates of ``docs``; None if there are none."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return fitted(text.mapInArrow(_counted, "kind string, features array<int>, n bigint"))


def fitted(counts: DataFrame) -> SpanModel | None:
    """Span classifier from (kind, features, n) rows; there are as many groups as the discrete features allow, at most."""
    rows = counts.groupBy("kind", "features").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.kind, r.features))
    kinds, feats, n = [r.kind for r in rows], np.array([r.features for r in rows]), np.array([r.n for r in rows], float)
    post, reliability = em(kinds, feats[:, : len(LABELERS)], n)
    x, w = design(kinds, feats), np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 2)
    ridge = 1e-3 * n.sum() * np.eye(len(w))
    ridge[0, 0] = 1e-9 * n.sum()
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - post)) + ridge @ w
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
    return SpanModel(w, reliability)


def _accepted(model: SpanModel, found: list, threshold: float, known: dict) -> list[tuple[int, int, str, float]]:
    out = []
    for a, b, kind, f in found:
        if (p := known.get((kind, f))) is None:
            p = known[kind, f] = model.score(kind, f)
        if p >= threshold:
            out.append((a, b, kind, p))
    return out


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
    for b in batches:
        ids = b.column("doc_id")
        rows = [(ids[r].as_py(), a, z, kind, list(f)) for r, _, found in _scan(b.column("text")) for a, z, kind, f in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start_char", "end_char", "kind", "features"])


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start_char, end_char, kind, score) of every private span.

    Texts are scanned once; the candidates are written down, counted for the model and then scored.
    """
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = text.mapInArrow(_located, "doc_id bigint, start_char bigint, end_char bigint, kind string, features array<int>").checkpoint()
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(found.groupBy("kind", "features").agg(F.count("*").alias("n"))))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shipped.value, {}
        for b in batches if model else ():
            pairs = list(zip(b.column("kind").to_pylist(), map(tuple, b.column("features").to_pylist()), strict=True))
            for kind, f in set(pairs) - known.keys():
                known[kind, f] = model.score(kind, f)
            score = pa.array([known[x] for x in pairs], pa.float64())
            out = pa.RecordBatch.from_arrays([*b.columns[:4], score], [*b.schema.names[:4], "score"])
            yield out.filter(pc.greater_equal(score, threshold))

    return found.mapInArrow(go, "doc_id bigint, start_char bigint, end_char bigint, kind string, score double")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every private span replaced by its kind; the columns stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs))
    names, sized = docs.columns, "n_chars" in docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shipped.value, {}
        for b in batches:
            if not model:
                yield b
                continue
            text = b.column("text")
            new, length = {}, {}
            for r, old, found in _scan(text):
                out, at = [], 0
                for a, z, kind, _ in _accepted(model, found, threshold, known):
                    out += [old[at:a], f"<{kind.upper()}>"]
                    at = z
                if out:
                    new[r] = "".join([*out, old[at:]])
                    length[r] = (len(old), len(new[r]))
            if not new:
                yield b
                continue
            where = np.zeros(b.num_rows, bool)
            where[list(new)] = True
            cols = list(b.columns)
            cols[names.index("text")] = pc.replace_with_mask(text, pa.array(where), pa.array([new[r] for r in sorted(new)], text.type))
            if sized:
                size = b.column("n_chars")
                fresh = pa.array([length[r][1] if size[r].as_py() == length[r][0] else size[r].as_py() for r in sorted(new)], size.type)
                cols[names.index("n_chars")] = pc.replace_with_mask(size, pa.array(where), fresh)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(releasing(go), docs.schema)
