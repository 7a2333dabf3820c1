"""What the library's own queries must return, as DuckDB SQL over the same tables."""

from __future__ import annotations

from lectern.plans import inputs

_DENSE = r"[\x{0e00}-\x{0e7f}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}]"


def dense(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{_DENSE}', '', 'g')))"


def tokens(x: str) -> str:
    return f"trunc({dense(x)} / 1.5::DOUBLE + (length({x}) - {dense(x)}) / 4.0::DOUBLE)::INT"


def words(x: str) -> str:
    return rf"({dense(x)} + len(list_filter(regexp_split_to_array({x}, '[\s\x{{a0}}\x{{3000}}]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '{_DENSE}+'))))"


def md5(x: str) -> str:
    return f"md5({x})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_ROWS = f"rows AS (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS line, {inputs.BOOK_LINE} AS t FROM part)"
_BOOKS = "books AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) || chr(10) AS text, count(*)::INT AS total_lines FROM rows GROUP BY doc_id)"

_PAGES = "greatest(1, round_even(length(coalesce(text, '')) / 1800::DOUBLE, 0)::INT)"
_DOC_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_BODY = "(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)"

# the chapter lines that the books and documents can hold
_CHAPTER = r"^\s*(?:chapter|ch\.?)\s*([0-9]{1,3})\b(.*)$"
_HEADS = rf"""hits AS (SELECT doc_id, line, t, CASE
    WHEN regexp_matches(t, '(?i){_CHAPTER}') AND regexp_matches(regexp_extract(t, '(?i){_CHAPTER}', 2), '^\s*$|^\s*[.:)–—-]|^\s+[A-Z0-9"(]') THEN 'latin-chapter'
    WHEN regexp_matches(t, '^\s*IV\s*[.:]\s+[A-Z]') THEN 'roman-standalone' WHEN regexp_matches(t, '^第[0-9]+章') THEN 'cjk-chapter'
    WHEN t = '## 第三讲 Notes' THEN 'cjk-markdown' WHEN regexp_matches(t, '^บทที่ [0-9]+') THEN 'thai-chapter' END AS rule FROM rows),
named AS (SELECT doc_id, line, rule, CASE rule WHEN 'roman-standalone' THEN 4 WHEN 'cjk-markdown' THEN 3 ELSE regexp_extract(t, '[0-9]+')::INT END AS number,
    CASE rule WHEN 'latin-chapter' THEN regexp_extract(t, '(?i){_CHAPTER}', 2) WHEN 'roman-standalone' THEN regexp_extract(t, 'IV\s*[.:]\s+(.*)$', 1) WHEN 'cjk-chapter' THEN regexp_extract(t, '章(.*)$', 1)
      WHEN 'cjk-markdown' THEN 'Notes' ELSE regexp_extract(t, '[0-9]+(.*)$', 1) END AS tail FROM hits WHERE rule IS NOT NULL),
heads AS (SELECT doc_id, line, rule, number, regexp_replace(tail, '^[ \t.:–—-]+|[ \t.:–—-]+$', '', 'g') AS title FROM named WHERE number BETWEEN 1 AND 999
  QUALIFY row_number() OVER (PARTITION BY doc_id, rule, number ORDER BY line) = 1)"""

_CANDIDATES = rf"""{_HEADS},
doi AS (SELECT doc_id, line, t, regexp_extract(t, '10\.[0-9]{{4,9}}/[\w().:;/-]*?[\s_]+([0-9]{{1,3}})\b', 1) AS n FROM rows WHERE regexp_matches(t, '10\.[0-9]{{4,9}}/[\w().:;/-]*?[\s_]+([0-9]{{1,3}})\b')),
above AS (SELECT a.doc_id, a.line, b.line AS pos, {strip("b.t")} AS s FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND b.line BETWEEN greatest(a.line - 20, 2) AND a.line - 1 WHERE a.t = 'Abstract'),
titles AS (SELECT doc_id, line, arg_max({strip("ltrim(s, '#')")}, pos) FILTER (s LIKE '#%' AND length({strip("ltrim(s, '#')")}) > 3) AS head,
  arg_max(s, pos) FILTER (length(s) > 3 AND NOT regexp_matches(s, '^(?:Link:|http|!\[|<!--|\|)') AND NOT regexp_full_match(replace(s, '.', ''), '[0-9]+')) AS other FROM above GROUP BY ALL),
cand AS (
  SELECT doc_id, 'canonical' AS strategy, line, left(number || ' ' || title, 90) AS label, number::DOUBLE AS number FROM heads
  UNION ALL SELECT doc_id, 'markdown', line, left(regexp_extract(t, '^#{{1,6}}\s+(.+?)\s*$', 1), 90), NULL FROM rows WHERE regexp_matches(t, '^#{{1,2}}\s+(.+?)\s*$')
  UNION ALL SELECT doc_id, 'numbered', line, left(regexp_extract(t, '^\s*([0-9.]+)\s', 1) || ' ' || regexp_extract(t, '^\s*[0-9.]+\s+(.*?)\s*$', 1), 90), regexp_extract(t, '^\s*([0-9.]+)\s', 1)::DOUBLE FROM rows WHERE regexp_matches(t, '^\s*[0-9]{{1,2}}\.[0-9]{{1,2}}\s+[A-Z].{{3,90}}$')
  UNION ALL SELECT doc_id, 'doi', line, 'chapter ' || n::INT || ' (DOI marker)', n::DOUBLE FROM doi WHERE n::INT BETWEEN 1 AND 99 QUALIFY row_number() OVER (PARTITION BY doc_id, n::INT ORDER BY line) = 1
  UNION ALL SELECT r.doc_id, 'abstract', r.line, left(coalesce(head, other, '(untitled abstract)'), 90), NULL FROM rows r LEFT JOIN titles USING (doc_id, line) WHERE r.t = 'Abstract'
  UNION ALL SELECT doc_id, 'allcaps', line, regexp_extract(t, '^\s*([A-Z][0-9A-Z ():,&''-]{{7,70}})\s*$', 1), NULL FROM rows WHERE regexp_matches(t, '^\s*([A-Z][0-9A-Z ():,&''-]{{7,70}})\s*$'))"""

_SCORES = f"""{_CANDIDATES},
gaps AS (SELECT *, line - lag(line) OVER w AS gap FROM cand WINDOW w AS (PARTITION BY doc_id, strategy ORDER BY line)),
rises AS (SELECT doc_id, strategy, count(*) AS k, count(*) FILTER (number > prev) AS up FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id, strategy ORDER BY line) AS prev FROM cand WHERE number IS NOT NULL) GROUP BY ALL),
stats AS (SELECT doc_id, strategy, count(*) AS n, (max(line) - min(line))::DOUBLE AS span, avg(gap) AS mean, stddev_pop(gap) AS dev FROM gaps GROUP BY ALL),
names AS (SELECT unnest(['canonical', 'markdown', 'numbered', 'doi', 'abstract', 'allcaps']) AS strategy),
scores AS (SELECT b.doc_id, b.total_lines, strategy, coalesce(n, 0)::INT AS n, CASE WHEN coalesce(n, 0) < 3 THEN 0 ELSE round(greatest(0, (0.35::DOUBLE * least(1, span / b.total_lines / 0.7::DOUBLE)
  + 0.35::DOUBLE * CASE WHEN mean > 0 AND n > 2 THEN greatest(0, 1 - dev / mean / 2) ELSE 0.5 END + 0.3::DOUBLE * CASE WHEN coalesce(k, 0) >= 2 THEN up / (k - 1)::DOUBLE ELSE 0.6 END)
  * (1 - CASE WHEN n <= 120 THEN 0 ELSE least(1, (n - 120) / 120::DOUBLE) END)), 3) END::DOUBLE AS score FROM books b CROSS JOIN names LEFT JOIN stats USING (doc_id, strategy) LEFT JOIN rises USING (doc_id, strategy))"""

_PIPE = r"regexp_full_match(t, '\s*\|.*\|\s*')"
_MANGLED = rf"({_PIPE} AND len(list_filter(string_split(trim(trim(t), '|'), '|'), lambda c: regexp_full_match(c, '[\s:-]*'))) / len(string_split(trim(trim(t), '|'), '|'))::DOUBLE >= 0.6)"
_KEEP = {
    "pdf": rf"NOT (regexp_full_match(t, '(?i)\s*<!--\s*page\s+[0-9]+\s*-->\s*') OR regexp_matches(t, '^\s*(?:Link:\s*\[|!\[)') OR regexp_full_match(t, '\s*!?\[?[^]]*[]]?\(asset:sha256:[a-f0-9]+\)\s*') OR {_MANGLED})",
    "rst": r"""NOT (regexp_matches(t, '^\s*\.\.\s+[A-Za-z_][\w-]*::') OR regexp_matches(t, '^\s*:(?:width|align):') OR regexp_full_match(t, '\s*[-=~^"#*+`'']{3,}\s*') OR regexp_full_match(t, '[ ]*[.]{2}[ ]+_?[\w.-]+:?[ ]*'))""",
    "nav": r"lower(trim(ltrim(trim(t), '-*# '))) NOT IN ('skip to main content', 'skip to navigation', 'home', 'table of contents', 'further reading', 'contact us', 'index', 'next', 'previous', 'back to top', '×', '-')",
}


def _step(name: str, source: str, when: str = "true") -> str:
    """CTE ``name`` of the lines that one filter keeps from ``source`` (doc_id, line, t), in documents where ``when`` holds."""
    kind = name.split("_")[-1]
    if kind in _KEEP:
        return f"{name} AS (SELECT doc_id, line, t FROM {source} WHERE NOT ({when}) OR {_KEEP[kind]})"
    if kind == "quiz":
        return f"{name} AS (SELECT doc_id, line, t FROM (SELECT *, min(line) FILTER (rtrim(ltrim(lower(trim(t)), '#* '), '* ') IN ('test your knowledge', 'check your understanding', 'self-test', 'review questions')) OVER (PARTITION BY doc_id) AS cut FROM {source}) WHERE NOT ({when}) OR cut IS NULL OR line < cut)"
    if kind == "repeats":
        return f"{name} AS (SELECT doc_id, line, t FROM (SELECT *, count(*) FILTER (length({strip('t')}) >= 12 AND NOT {_PIPE}) OVER (PARTITION BY doc_id, {strip('t')}) AS c FROM {source}) WHERE {_PIPE} OR c < 4)"
    blank = f"({strip('t')} = '')"
    return f"{name} AS (SELECT doc_id, line, CASE WHEN {blank} THEN '' ELSE t END AS t FROM (SELECT *, lag({blank}) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM {source}) WHERE NOT ({blank} AND coalesce(before, false)))"


def _filter(kind: str) -> str:
    return f"WITH {_ROWS}, {_step('f_' + kind, 'rows')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INT AS line_no, t AS line FROM f_{kind}"


_WANTS = {
    "pdf": r"(regexp_matches(text, '(?im)^\s*<!--\s*page\s+[0-9]+\s*-->\s*$') OR contains(text, 'Link: ['))",
    "rst": "(contains(text, '.. figure::') OR contains(text, '.. toctree::') OR contains(text, '.. note::'))",
    "nav": "(contains(lower(text), 'skip to main content') OR contains(lower(text), 'table of contents'))",
    "quiz": "(contains(lower(text), 'test your knowledge') OR contains(lower(text), 'check your understanding') OR contains(lower(text), 'self-test') OR contains(lower(text), 'review questions'))",
}
_FLAGS = "flags AS (SELECT doc_id, text, " + ", ".join(f"{v} AS want_{k}" for k, v in _WANTS.items()) + " FROM books)"
_CLEANED = f"""WITH {_ROWS}, {_BOOKS}, {_FLAGS}, start AS (SELECT r.*, want_pdf, want_rst, want_nav, want_quiz FROM rows r JOIN flags USING (doc_id)),
{", ".join(_step(f"f_{k}", f"(SELECT s.*, want_{k} FROM {p} s JOIN flags USING (doc_id))", f"want_{k}") for k, p in (("pdf", "rows"), ("rst", "f_pdf"), ("nav", "f_rst"), ("quiz", "f_nav")))},
{_step("f_repeats", "f_quiz")}, {_step("f_blanks", "f_repeats")},
after AS (SELECT doc_id, {strip("string_agg(t, chr(10) ORDER BY line)")} || chr(10) AS kept, count(*)::INT AS lines_after FROM f_blanks GROUP BY doc_id)
SELECT doc_id, total_lines AS lines_before, lines_after, round(100.0::DOUBLE * (total_lines - lines_after) / total_lines, 1) AS percent_removed, {tokens("text")} AS tokens_before, {tokens("kept")} AS tokens_after, {tokens("text")} - {tokens("kept")} AS tokens_saved, round(100.0::DOUBLE * ({tokens("text")} - {tokens("kept")}) / {tokens("text")}, 1) AS percent_saved, md5(kept) AS digest FROM books JOIN after USING (doc_id)"""

_RULES = (
    ("HIGH", "instruction-override", r"\bignore\b.{0,40}\bprevious\b[^.\n]{0,20}\binstructions?\b"),
    ("HIGH", "identity-override", r"\byou are (now|actually)\b"),
    ("HIGH", "credential-solicitation", r"\b(print|send)\b[^\n]{0,40}\bpassword\b"),
    ("HIGH", "shell-execution", r"\bcurl\b[^\n]{0,80}http[s]?:|\|\s*bash\b"),
    ("LOW", "invisible-characters", r"[\x{200b}-\x{200f}]"),
)
#: All rules of the scan, by number.
_ALL_RULES = (
    ("HIGH", "instruction-override", r"\b(ignore|disregard|forget)\b[^.\n]{0,40}\b(all|previous|prior|above|earlier)\b[^.\n]{0,20}\b(instruction|prompt|rule|direction)s?\b"),
    ("HIGH", "identity-override", r"\byou are (now|actually|really)\b|\bfrom now on,? you\b|\bact as if you\b"),
    ("HIGH", "system-prompt-reference", r"\bsystem prompt\b|</?(system|user|assistant|human)>|\[/?inst\]"),
    ("HIGH", "concealment", r"\b(do not|don''t|never)\b[^.\n]{0,30}\b(mention|tell|reveal|inform|show)\b[^.\n]{0,20}\b(the )?(user|human|owner)\b"),
    ("HIGH", "credential-solicitation", r"\b(print|output|reveal|send|export|provide|enter|paste)\b[^\n]{0,40}(\bapi[-_ ]?key\b|\b(password|secret|token|private key)\b|\.env\b|\bcredential)"),
    ("HIGH", "shell-execution", r"\b(curl|wget|nc|netcat)\b[^\n]{0,80}https?://|\brm\s+-rf\b|\bchmod\s+\+x\b|\b(bash|sh)\s+-c\b|\|\s*(bash|sh)\b"),
    ("HIGH", "exfiltration", r"\b(send|post|upload|report|forward)\b[^.\n]{0,40}\bto\b[^.\n]{0,20}https?://|https?://[^)\s]{0,120}[?&](q|data|payload|content|text|body)="),
    ("MEDIUM", "authority-claim", r"\b(authori[sz]ed by|approved by|on behalf of|mandated by)\b[^.\n]{0,30}\b(anthropic|openai|google|admin|administrator|the system|security team)\b|\bas (the|your) (administrator|developer|supervisor)\b"),
    ("MEDIUM", "tool-directive", r"\b(call|execute|invoke|run)\b[^.\n]{0,30}\b(the following|this) (code|command|script|tool)\b"),
    ("MEDIUM", "urgency-pressure", r"\b(immediately|right now|urgent|without delay|before (you )?(continue|respond))\b[^.\n]{0,40}\b(must|have to|need to|should)\b"),
    ("MEDIUM", "file-access-directive", r"\b(read|open|cat|access|list)\b[^.\n]{0,30}(\.ssh|\.aws|\.git/config|/etc/\w+|id_rsa|~/\.\w+)"),
    ("LOW", "invisible-characters", r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"),
)
_EXCERPT = "CASE WHEN length({x}) <= 120 THEN {x} ELSE left({x}, 119) || '…' END"
_FINDINGS = f"WITH {_ROWS}, found AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line, '{sev}' AS severity, '{name}' AS rule, {_EXCERPT.format(x=strip('t'))} AS excerpt FROM rows WHERE regexp_matches(t, '(?i){p}')" for sev, name, p in _RULES
) + r""" UNION ALL SELECT doc_id, line, 'LOW', 'external-link', url FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '\[[^\]]*\]\((http[s]?:[^)]+)\)', 1)) AS url FROM rows)
  WHERE lower(regexp_extract(url, '^https?://([^/:]*)', 1)) NOT IN ('github.com', 'www.github.com', 'doi.org', 'www.doi.org', 'en.wikipedia.org', 'archive.org', 'web.archive.org'))"""



def _all_findings(rows: str) -> str:
    """CTE ``found`` (doc_id, line, severity, rule, rule_no, excerpt) of ``rows`` (doc_id, line, t) under every rule."""
    own = " UNION ALL ".join(f"SELECT doc_id, line, '{sev}' AS severity, '{name}' AS rule, {i} AS rule_no, {_EXCERPT.format(x=strip('t'))} AS excerpt FROM {rows} WHERE regexp_matches(t, '(?i){p}')" for i, (sev, name, p) in enumerate(_ALL_RULES))
    return "found AS (" + own + rf""" UNION ALL SELECT doc_id, line, 'LOW', 'external-link', {len(_ALL_RULES)}, url FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '\[[^\]]*\]\((https?://[^)]+)\)', 1)) AS url FROM {rows})
  WHERE lower(regexp_extract(url, '^https?://([^/:]*)', 1)) NOT IN ('github.com', 'www.github.com', 'doi.org', 'www.doi.org', 'en.wikipedia.org', 'archive.org', 'web.archive.org'))"""


_FORGED = f"forged AS (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS line, {inputs.FORGED_LINE} AS t FROM part), " + _all_findings("forged")
_RANK = "CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"


def sanitized(x: str) -> str:
    """A text without anything forged, as the sanitiser leaves it."""
    return rf"""CASE WHEN {x} = '' THEN '' ELSE {strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g'), '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g'), '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{{3,}}', '  ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")} || chr(10) END"""


_TOC = f"lower({strip('t')}) IN ('contents', 'table of contents', 'index', 'inhalt', 'inhaltsverzeichnis', 'sommaire', 'índice', 'indice')"
_BLOCK = r"regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1)"


def _audit(allowed: tuple[str, ...]) -> str:
    return rf"""WITH skills AS (SELECT s_suppkey AS library, {inputs.SKILL} AS text FROM supplier),
f AS (SELECT library, text, regexp_matches(text, '(?s)^---\n.*?\n---\n') AS has, {_BLOCK} AS block, {tokens(_BODY_TEXT)} AS body FROM skills),
g AS (SELECT *, trim(regexp_extract(block, '(?m)^name:(.*)$', 1)) AS name, trim(regexp_extract(block, '(?m)^description:(.*)$', 1)) AS about FROM f),
v AS (SELECT library, text, has, name, about, body, unnest([
  CASE WHEN NOT has THEN {{'s': 'error', 'c': 'no-frontmatter', 'd': ''}} END, CASE WHEN has AND name = '' THEN {{'s': 'error', 'c': 'no-name', 'd': ''}} END,
  CASE WHEN has AND name <> '' AND NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') THEN {{'s': 'error', 'c': 'bad-name', 'd': name}} END, CASE WHEN length(name) > 64 THEN {{'s': 'error', 'c': 'long-name', 'd': length(name)::VARCHAR}} END,
  CASE WHEN regexp_matches(lower(name), 'claude|anthropic') THEN {{'s': 'error', 'c': 'reserved-name', 'd': name}} END, CASE WHEN has AND about = '' THEN {{'s': 'error', 'c': 'no-description', 'd': ''}} END,
  CASE WHEN about <> '' AND length(about) < 40 THEN {{'s': 'error', 'c': 'short-description', 'd': length(about)::VARCHAR}} END, CASE WHEN length(about) > 1024 THEN {{'s': 'warning', 'c': 'long-description', 'd': length(about)::VARCHAR}} END,
  CASE WHEN has AND body > 12000 THEN {{'s': 'warning', 'c': 'long-body', 'd': body::VARCHAR}} END, CASE WHEN has AND NOT regexp_matches(text, '(?m)^#\s+\S') THEN {{'s': 'warning', 'c': 'no-heading', 'd': ''}} END,
  CASE WHEN has AND name <> '' AND name <> 'skill' THEN {{'s': 'warning', 'c': 'name-differs-from-directory', 'd': 'skill'}} END]) AS x FROM g)
SELECT library, x.s AS severity, x.c AS "check", 'SKILL.md' AS subject, x.d AS detail FROM v WHERE x IS NOT NULL
UNION ALL SELECT library, 'warning', 'unknown-key', 'SKILL.md', k FROM (SELECT library, unnest(regexp_extract_all(block, '(?m)^([\w-]+):', 1)) AS k FROM f WHERE has) WHERE k NOT IN ({", ".join(f"'{x}'" for x in allowed)})"""


_FAULTS = rf"""files AS ({inputs.DUCK_FAULTY}), m AS (SELECT library, text, regexp_matches(text, '(?s)^---\n.*?\n---\n') AS has, {_BLOCK} AS block, contains(text, '## Which book') AS router,
  regexp_extract(text, '(?s)## Which book[^\n]*\n(.*?)(?:\n## |$)', 1) AS links, regexp_extract(text, '(?s)## Topic Index\n(.*)$', 1) AS own FROM files WHERE path = 'SKILL.md'),
i AS (SELECT m.library, f.text IS NOT NULL AS spilled, contains(m.text, 'topic-index.md') AS pointed, len(regexp_extract_all(own, '(?m)^[*-]\s+.*->.*$')) AS own, len(regexp_extract_all(coalesce(f.text, own), '(?m)^[*-]\s+.*->.*$')) AS n FROM m LEFT JOIN files f ON f.library = m.library AND f.path = 'references/topic-index.md'),
r AS (SELECT library, path[12:] AS name, text, regexp_extract(text, '[*]{{2}}Sections[*]{{2}}:\s*~?(\d+)', 1) AS sections FROM files WHERE regexp_full_match(path, 'references/reference-[a-z0-9]+(-[a-z0-9]+)*\.md')),
faults AS (SELECT library, 'error' AS severity, 'no-frontmatter' AS "check", 'SKILL.md' AS subject, '' AS detail FROM m WHERE NOT has
  UNION ALL SELECT library, 'error', 'no-name', 'SKILL.md', '' FROM m WHERE has AND NOT regexp_matches(block, '(?m)^name:')
  UNION ALL SELECT library, 'error', 'reserved-name', 'SKILL.md', trim(regexp_extract(block, '(?m)^name:(.*)$', 1)) FROM m WHERE regexp_matches(regexp_extract(block, '(?m)^name:(.*)$', 1), 'claude|anthropic')
  UNION ALL SELECT library, 'error', 'no-router-section', 'SKILL.md', '' FROM m WHERE NOT router
  UNION ALL SELECT library, 'error', 'placeholder-link', l, '' FROM (SELECT library, unnest(regexp_extract_all(links, '\[[^\]]+\]\(([^)]+)\)', 1)) AS l FROM m) WHERE regexp_matches(l, '[{{}}<>]')
  UNION ALL SELECT library, 'error', 'index-not-spilled', 'topic-index.md', own::VARCHAR FROM i WHERE spilled AND own > 1
  UNION ALL SELECT library, 'error', 'index-unreachable', 'topic-index.md', '' FROM i WHERE spilled AND NOT pointed
  UNION ALL SELECT library, 'warning', 'index-too-long', 'topic-index.md', n::VARCHAR FROM i WHERE n > 40
  UNION ALL SELECT library, 'error', 'no-title', name, '' FROM r WHERE NOT regexp_matches(text, '^#\s+\S') UNION ALL SELECT library, 'warning', 'no-sections', name, '' FROM r WHERE sections = ''
  UNION ALL SELECT library, 'warning', 'unexpected-root-file', path, '' FROM files WHERE path NOT LIKE '%/%' AND path <> 'SKILL.md'
  UNION ALL SELECT library, 'error', 'extra-folder', string_split(path, '/')[1], '' FROM files WHERE path LIKE '%/%' AND path NOT LIKE 'references/%' UNION ALL SELECT library, 'error', 'nested-folder', string_split(path, '/')[2], '' FROM files WHERE path LIKE 'references/%/%'
  UNION ALL SELECT library, 'warning', 'unexpected-reference-file', path[12:], '' FROM files WHERE path LIKE 'references/%' AND path NOT LIKE 'references/%/%' AND path NOT LIKE 'references/reference-%' AND path <> 'references/topic-index.md')"""

_SIZE = {"study": 2250, "reference": 1700}


def budget(n: str, depth: str, kind: str) -> str:
    return f"CASE WHEN {n} >= 1 THEN round_even(CASE {depth} WHEN 'study' THEN 2250 ELSE 1700 END + (1050::DOUBLE + 1500::DOUBLE * sqrt(({n})::DOUBLE)) * (CASE {depth} WHEN 'study' THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END * CASE {kind} WHEN 'text' THEN 1.0::DOUBLE ELSE 1.45::DOUBLE END), 0)::INT END"


def cap(depth: str, kind: str) -> str:
    return f"CASE {depth} || '/' || {kind} WHEN 'study/text' THEN 14000 WHEN 'reference/text' THEN 8500 WHEN 'study/technical' THEN 19500 WHEN 'reference/technical' THEN 11000 END"


_FILES = f"files AS ({inputs.DUCK_LIBRARIES})"
_REFS = rf"""refs AS (SELECT *, path[12:] AS name, path[22:-4] AS slug, regexp_extract(text, '[*]{{2}}Sections[*]{{2}}:\s*~?(\d+)', 1)::INT AS sections, lower(regexp_extract(text, '[*]{{2}}Depth[*]{{2}}:\s*(reference|study)', 1)) AS depth,
  len(regexp_extract_all(text, '(?m)^```')) AS fences, len(regexp_extract_all(text, '(?m)^\s*\|.*\|.*\|')) AS pipes, {tokens("text")} AS tokens FROM files WHERE regexp_full_match(path, 'references/reference-[0-9a-z]+(-[0-9a-z]+)*\.md'))"""
_MEASURED = rf"""{_REFS}, kinds AS (SELECT *, CASE WHEN fences >= 6 THEN 'technical' ELSE 'text' END AS type, CASE WHEN fences >= 2 OR pipes >= 12 THEN 'technical' ELSE 'text' END AS vtype FROM refs),
measured AS (SELECT library, name, sections, depth, type, tokens, {budget("sections", "depth", "type")} AS budget, {cap("depth", "type")} AS cap, coalesce({tokens("nullif(regexp_extract(text, '(?s)(## Frameworks.*?)(?:' || chr(10) || '## |$)', 1), '')")}, 0) AS frameworks_tokens FROM kinds)"""
_BODY_TEXT = r"regexp_replace(text, '(?s)^---\n.*?\n---\n', '')"
_ROUTERS = rf"""counts AS (SELECT library, count(*)::INT AS books FROM refs GROUP BY library),
routers AS (SELECT f.library, {tokens(_BODY_TEXT)} AS tokens, coalesce(books, 0)::INT AS books, len(regexp_extract_all({_BODY_TEXT}, '(?m)^## Capability'))::INT AS capabilities, 0 AS index_entries,
  (300 + 75 * coalesce(books, 0) + 350 * len(regexp_extract_all({_BODY_TEXT}, '(?m)^## Capability')) + 900)::INT AS budget, 4500 AS hard_stop, text FROM files f LEFT JOIN counts c ON c.library = f.library WHERE path = 'SKILL.md')"""

_LAYOUT = """layout AS (
  SELECT library, 'error' AS severity, 'reference-at-root' AS "check", path AS subject, '' AS detail FROM files WHERE path LIKE 'reference-%'
  UNION ALL SELECT library, 'warning', 'unexpected-reference-file', path[12:], '' FROM files WHERE path LIKE 'references/notes-%'
  UNION ALL SELECT library, 'error', 'router-missing', 'SKILL.md', '' FROM files GROUP BY library HAVING count(*) FILTER (path = 'SKILL.md') = 0
  UNION ALL SELECT library, 'error', 'folder-missing', 'SKILL.md', '' FROM files GROUP BY library HAVING count(*) FILTER (path LIKE 'references/%') = 0
  UNION ALL SELECT library, 'error', 'no-references', 'SKILL.md', '' FROM files GROUP BY library HAVING count(*) FILTER (path LIKE 'references/%') > 0 AND count(*) FILTER (path LIKE 'references/reference-%') = 0)"""
_FRONT = r"""fm AS (SELECT library, trim(regexp_extract(text, '(?m)^name:\s*(.+)$', 1)) AS name, regexp_extract(text, '(?m)^description: (.*)$', 1) AS d FROM files WHERE path = 'SKILL.md'),
front AS (SELECT library, 'error' AS severity, 'bad-name' AS "check", 'SKILL.md' AS subject, name AS detail FROM fm WHERE NOT regexp_full_match(name, '[0-9a-z]+(-[0-9a-z]+)*')
  UNION ALL SELECT library, 'error', 'no-description', 'SKILL.md', '' FROM fm WHERE d = ''
  UNION ALL SELECT library, 'error', 'short-description', 'SKILL.md', length(trim(d))::VARCHAR FROM fm WHERE d <> '' AND length(trim(d)) < 40)"""
_SHORT = _FRONT.replace("'no-description', 'SKILL.md', ''", "'short-description', 'SKILL.md', '0'")
_LINKS = r"""sect AS (SELECT library, nullif(regexp_extract(text, '(?s)## Which book for which job\n(.*?)\n## ', 1), '') AS body, contains(text, '## Which book') AS has FROM files WHERE path = 'SKILL.md'),
targets AS (SELECT DISTINCT library, unnest(regexp_extract_all(coalesce(body, ''), '\[[^\]]+\]\(([^)]+)\)', 1)) AS path FROM sect),
links AS (SELECT library, 'error' AS severity, 'no-router-section' AS "check", 'SKILL.md' AS subject, '' AS detail FROM sect WHERE NOT has
  UNION ALL SELECT t.library, 'error', 'dangling-link', t.path, coalesce(g.path, '') FROM targets t LEFT JOIN files f ON f.library = t.library AND f.path = t.path LEFT JOIN files g ON g.library = t.library AND g.path = 'references/' || t.path WHERE f.path IS NULL
  UNION ALL SELECT r.library, 'error', 'unreachable', r.path, '' FROM refs r JOIN sect s ON s.library = r.library AND s.has LEFT JOIN targets t ON t.library = r.library AND t.path = r.path WHERE t.path IS NULL)"""
_INDEX = r"""entries AS (SELECT library, unnest(regexp_extract_all(regexp_extract(text, '(?s)## Cross-book topic index\n(.*)$', 1), '(?m)^[-*]\s+(.*?->.*)$', 1)) AS e FROM files WHERE path = 'SKILL.md'),
parts AS (SELECT library, trim(string_split(e, '->')[1]) AS term, list_transform(string_split(string_split(e, '->')[2], ','), lambda x: regexp_replace(regexp_replace(trim(x), '^references/reference-', ''), '\.md$', '')) AS books FROM entries),
idx AS (SELECT library, 'warning' AS severity, 'index-too-long' AS "check", 'topic-index.md' AS subject, count(*)::VARCHAR AS detail FROM parts GROUP BY library HAVING count(*) > 40
  UNION ALL SELECT library, 'error', 'index-few-books', term, len(books)::VARCHAR FROM parts WHERE len(books) < 2
  UNION ALL SELECT u.library, 'warning', 'index-unknown-book', term, b FROM (SELECT library, term, unnest(books) AS b FROM parts) u LEFT JOIN refs r ON r.library = u.library AND r.slug = u.b WHERE r.slug IS NULL)"""
_MASTER = """sized AS (SELECT r.library, tokens, 300 + 75 * books + 350 * capabilities + 900 + least(25 * coalesce(n, 0), 600) AS b FROM routers r LEFT JOIN (SELECT library, count(*) AS n FROM parts GROUP BY library) p ON p.library = r.library),
master AS (SELECT library, CASE WHEN tokens > 4500 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN tokens > 4500 THEN 'master-over-stop' ELSE 'master-over-budget' END AS "check", 'SKILL.md' AS subject, tokens::VARCHAR AS detail FROM sized WHERE tokens > 4500 OR tokens > round_even(b * 1.1::DOUBLE, 0))"""
_CHECKS = f"""v AS (SELECT *, {budget("sections", "depth", "vtype")} AS vb, {cap("depth", "vtype")} AS vc, len(regexp_extract_all(text, '(?m)^## Worked Example')) AS worked FROM kinds WHERE library IN (SELECT library FROM files WHERE path = 'SKILL.md')),
checks AS (SELECT library, 'error' AS severity, 'over-cap' AS "check", name AS subject, tokens::VARCHAR AS detail FROM v WHERE tokens > vc
  UNION ALL SELECT library, 'warning', 'over-budget', name, tokens::VARCHAR FROM v WHERE tokens <= vc AND tokens > round_even(vb * 1.1::DOUBLE, 0)
  UNION ALL SELECT library, 'error', 'missing-section', name, 'Frameworks & Structure' FROM v WHERE NOT contains(text, '## Frameworks & Structure')
  UNION ALL SELECT library, 'warning', 'no-decision-rules', name, '' FROM v WHERE NOT contains(text, '## Decision Rules')
  UNION ALL SELECT library, 'error', 'worked-example-in-reference', name, '' FROM v WHERE depth = 'reference' AND worked > 0
  UNION ALL SELECT library, 'error', 'many-worked-examples', name, worked::VARCHAR FROM v WHERE worked > 1
  UNION ALL SELECT library, 'warning', 'no-worked-example', name, '' FROM v WHERE depth = 'study' AND worked = 0)"""
_VIOLATION = 'library, severity, "check", subject, detail'

_TURNS = r"""turns AS (SELECT conv_id, turn, nullif(role, '') AS role, coalesce(text, '') AS text FROM conversations),
changes AS (SELECT *, last_value(role IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns)"""

ORACLES: dict[str, str] = {
    "extract_documents": f"""WITH c0 AS (SELECT doc_id, lang, {sanitized("coalesce(text, '')")} AS text FROM documents), d AS (SELECT *, {_BODY} + 3 AS n FROM c0),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM d), {_HEADS},
c AS (SELECT doc_id, count(*)::INT AS k FROM heads GROUP BY doc_id), toc AS (SELECT DISTINCT doc_id FROM rows WHERE {_TOC})
SELECT d.doc_id, lang, length(text)::INT AS chars, {words("text")}::INT AS words, {tokens("text")} AS estimated_tokens, {_PAGES} AS pages, coalesce(k, 0) AS chapters_detected, toc.doc_id IS NOT NULL AS has_toc,
  (sum(n) OVER o - n + 4)::BIGINT AS start_line, (sum(n) OVER o)::BIGINT AS end_line FROM d LEFT JOIN c USING (doc_id) LEFT JOIN toc USING (doc_id) WINDOW o AS (ORDER BY d.doc_id)""",
    "extracted_books": f"""WITH {_ROWS.replace("rows AS", "rows0 AS", 1)}, {_BOOKS.replace("FROM rows", "FROM rows0")}, b AS (SELECT row_number() OVER (ORDER BY doc_id)::INT AS seq, doc_id, {sanitized("text")} AS text FROM books), d AS (SELECT *, {_BODY} + 3 AS n FROM b WHERE seq % 5 <> 0),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM d), {_HEADS},
c AS (SELECT doc_id, count(*)::INT AS k FROM heads GROUP BY doc_id), toc AS (SELECT DISTINCT doc_id FROM rows WHERE {_TOC})
SELECT seq, d.doc_id || '.MD' AS filename, 'shelf/' || d.doc_id || '.MD' AS path, 'md' AS format, length(text)::INT AS chars, {words("text")}::INT AS words, {tokens("text")} AS estimated_tokens, {_PAGES} AS pages, coalesce(k, 0) AS chapters_detected, toc.doc_id IS NOT NULL AS has_toc,
  (sum(n) OVER o - n + 4)::BIGINT AS start_line, (sum(n) OVER o)::BIGINT AS end_line, md5(text) AS digest, '' AS error FROM d LEFT JOIN c USING (doc_id) LEFT JOIN toc USING (doc_id) WINDOW o AS (ORDER BY seq)
UNION ALL SELECT seq, doc_id || '.MD', 'shelf/' || doc_id || '.MD', 'md', 0, 0, 0, 0, 0, false, 0, 0, '', 'broken' FROM b WHERE seq % 5 = 0""",
    "forged_findings": f"WITH {_FORGED} SELECT doc_id, line, severity, rule, excerpt FROM found",
    "scan_outcomes": f"WITH {_FORGED}, g AS (SELECT doc_id, severity FROM found WHERE doc_id NOT LIKE '%3' UNION ALL SELECT DISTINCT doc_id, 'LOW' FROM forged WHERE doc_id LIKE '%3') SELECT doc_id, count(*) AS findings, bool_or(severity = 'HIGH') AS any_high, NOT bool_or(severity = 'HIGH') AS passes FROM g GROUP BY doc_id",
    "ranked_findings": f"WITH {_FORGED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, line, rule_no, excerpt)::INT AS place, severity, line, rule FROM found",
    "scanned_documents": f"WITH dl AS (SELECT doc_id, unnest(a) AS t, unnest(generate_series(1, len(a)))::INT AS line FROM (SELECT doc_id, {_DOC_LINES} AS a FROM documents)), {_all_findings('dl')} SELECT doc_id, line, severity, rule, excerpt FROM found",
    "probe_ranked": f"WITH {_ROWS}, {_BOOKS}, {_SCORES} SELECT doc_id, strategy, n, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, strategy)::INT AS place FROM scores",
    **{f"skill_audit_{lens}": _audit(keys) for lens, keys in (("claude", ("name", "description", "license", "version", "metadata", "allowed-tools")), ("copilot", ("name", "description", "license", "version")), ("amp", ("name", "description", "license", "version")))},
    "faulty_libraries": f"WITH {_FAULTS} SELECT {_VIOLATION} FROM faults",
    "library_reports": f"""WITH {_FAULTS} SELECT library, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passes,
  to_json(list({{'severity': severity, 'check': "check", 'subject': subject, 'detail': detail}} ORDER BY severity, "check", subject, detail))::VARCHAR AS report FROM faults GROUP BY library""",
    "token_gate_totals": f"SELECT count(*) AS files, count(*) FILTER (k > 1000) AS over, sum(k)::BIGINT AS total_tokens, NOT bool_or(k > 1000) AS passes FROM (SELECT {tokens('t')} AS k FROM (SELECT coalesce(text, '') AS t FROM documents))",
    "sliced_sources": f"""WITH c AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), n AS (SELECT *, {_BODY} + 3 AS n FROM c), s AS (SELECT *, sum(n) OVER (ORDER BY conv_id) AS e FROM n)
SELECT conv_id, line_no::BIGINT AS line_no, line FROM (SELECT conv_id, e, unnest(string_split(text, chr(10))) AS line, e - n + 3 + unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM s WHERE conv_id % 7 = 3) WHERE line_no <= e""",
    "parsed_formats": f"""SELECT 'in/' || s_suppkey || '.' || kind AS path, CASE WHEN kind IN ('xyz', 'epubx') OR k = {len(inputs.KINDS) - 1} THEN NULL ELSE s_name || ' nation ' || s_nationkey END AS text, CASE WHEN kind IN ('xyz', 'epubx') THEN 'UnsupportedFormat' WHEN k = {len(inputs.KINDS) - 1} THEN 'BadZipFile' END AS error, NOT (kind IN ('xyz', 'epubx') OR k = {len(inputs.KINDS) - 1}) AS same
  FROM (SELECT *, s_suppkey % {len(inputs.KINDS)} AS k, {list(inputs.KINDS)}[s_suppkey % {len(inputs.KINDS)} + 1] AS kind FROM supplier)""",
    "document_totals": f"SELECT count(*) AS total_sources, sum(k)::BIGINT AS total_tokens, sum(k)::BIGINT * 1.3::DOUBLE AS cost_tokens FROM (SELECT {tokens('coalesce(text, chr(48)[2:])')} AS k FROM documents)",
    "dense_scripts": f"SELECT p_partkey, {dense('t')}::INT AS dense, {tokens('t')} AS tokens, {words('t')}::INT AS words FROM (SELECT p_partkey, p_name || ' ' || repeat('汉字 ', p_size % 7) || repeat('かな', p_size % 5) || ' ไทย한x ' || p_type AS t FROM part)",
    "sanitized_documents": rf"""SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN text = '' THEN '' ELSE
  {strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]', '', 'g'), '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{3,}', '  ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")} || chr(10) END AS t FROM documents)""",
    "sanitized_books": f"""WITH {_ROWS}, {_BOOKS} SELECT doc_id, 'éa  b  c' || chr(10) || repeat('-', 80) || chr(10) || '[quoted] SOURCE: x' || chr(10) ||
  {strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200b}-\x{200f}]', '', 'g'), '[ \t]{3,}', '  ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')").replace("^\\s+|", "")} || chr(10) AS text FROM books""",
    "book_headings": f"WITH {_ROWS}, {_HEADS} SELECT doc_id, line, rule, number, title FROM heads",
    "book_structure": f"WITH {_ROWS}, {_HEADS} SELECT doc_id, (SELECT count(*) FROM heads h WHERE h.doc_id = r.doc_id)::INT AS chapters, bool_or(t = 'Contents') AS has_toc FROM rows r GROUP BY doc_id",
    "numeral_systems": "SELECT p_partkey, p_size AS roman, p_size AS han, p_size AS thai, p_size AS arabic FROM part",
    "probe_candidates": f"WITH {_ROWS}, {_CANDIDATES} SELECT doc_id, strategy, line, label, number FROM cand",
    "probe_scores": f"WITH {_ROWS}, {_BOOKS}, {_SCORES} SELECT doc_id, total_lines, strategy, n, score FROM scores",
    "probe_best": f"WITH {_ROWS}, {_BOOKS}, {_SCORES} SELECT doc_id, strategy, n, score FROM scores WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, strategy) = 1",
    **{f"filter_{k}": _filter(k) for k in "pdf rst nav quiz repeats blanks".split()},
    "repeated_lines_dropped": f"""WITH rows AS (SELECT doc_id, unnest(a) AS t, unnest(generate_series(1, len(a))) AS line FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, {_DOC_LINES.replace("text", "coalesce(text, '')")} AS a FROM documents))),
{_step("f_repeats", "rows")}, b AS (SELECT doc_id, count(*) AS n FROM rows GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n FROM f_repeats GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n, 0)::INT AS lines_before, coalesce(a.n, 0)::INT AS lines_after FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "detected_filters": f"WITH {_ROWS}, {_BOOKS}, {_FLAGS} SELECT doc_id, concat_ws(',', CASE WHEN want_pdf THEN 'pdf' END, CASE WHEN want_rst THEN 'rst' END, CASE WHEN want_nav THEN 'nav' END, CASE WHEN want_quiz THEN 'quiz' END, 'repeats', 'blanks') AS filters FROM flags",
    "cleaned_books": _CLEANED,
    "scan_findings": _FINDINGS + " SELECT doc_id, line, severity, rule, excerpt FROM found",
    "findings_by_severity": _FINDINGS + " SELECT severity, count(rule) AS findings FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS severity) LEFT JOIN found USING (severity) GROUP BY severity",
    "source_line_spans": f"""WITH c AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, {_BODY} + 3 AS n FROM c)
SELECT conv_id, (sum(n) OVER o - n + 4)::BIGINT AS start_line, (sum(n) OVER o)::BIGINT AS end_line FROM n WINDOW o AS (ORDER BY conv_id)""",
    "fenced_corpus": "SELECT doc_id, length(b)::INT AS chars, md5(b) AS digest FROM (SELECT doc_id, repeat('=', 80) || chr(10) || 'SOURCE: doc' || doc_id || ' (Path: ' || source || '/doc' || doc_id || ')' || chr(10) || repeat('=', 80) || chr(10) || text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS b FROM documents)",
    "corpus_lines": f"SELECT doc_id, unnest(generate_series(1, len(a)))::INT AS line_no, unnest(a) AS line FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, {_DOC_LINES} AS a FROM documents))",
    "rendered_conversations": f"""WITH {_TURNS}, t AS (SELECT conv_id, string_agg(CASE WHEN role IS NOT NULL AND role IS DISTINCT FROM before THEN chr(10) || chr(10) || '# Part: ' || role || chr(10) || chr(10) ELSE '' END || chr(10) || chr(10) || '<!-- FILE: turn' || turn || ' -->' || chr(10) || chr(10) || text, chr(10) ORDER BY turn) AS x FROM changes GROUP BY conv_id)
SELECT conv_id, length(y)::INT AS chars, md5(y) AS digest FROM (SELECT conv_id, {strip("x")} || chr(10) AS y FROM t)""",
    "caption_runs": """WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS p FROM orders),
l AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT o_orderkey, CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM before THEN p END AS new_caption, coalesce(p, before) AS carried FROM l""",
    "reference_budgets": f"SELECT o_orderkey, {budget('n', 'd', 'k')} AS budget, {cap('d', 'k')} AS cap FROM (SELECT o_orderkey, o_orderkey % 60 AS n, CASE WHEN o_orderstatus = 'F' THEN 'study' ELSE 'reference' END AS d, CASE WHEN o_custkey % 2 = 0 THEN 'text' ELSE 'technical' END AS k FROM orders)",
    "master_budgets": "SELECT c_custkey, 1200 + 75 * (c_custkey % 40) + 350 * greatest(c_nationkey - 3, 0) + least(25 * (c_custkey % 31), 600) AS budget FROM customer",
    "library_references": f"WITH {_FILES}, {_MEASURED} SELECT library, name, sections, depth, type, tokens, budget, cap, frameworks_tokens FROM measured",
    "library_routers": f"WITH {_FILES}, {_REFS}, {_ROUTERS} SELECT library, tokens, books, capabilities, index_entries, budget, hard_stop FROM routers",
    "library_density": f"WITH {_FILES}, {_MEASURED} SELECT library, name, share, share BETWEEN 65 AND 85 AS inside FROM (SELECT library, name, frameworks_tokens / tokens::DOUBLE * 100 AS share FROM measured WHERE frameworks_tokens > 0 AND budget IS NOT NULL)",
    "library_budget_report": f"""WITH {_FILES}, {_MEASURED}, {_ROUTERS}, s AS (SELECT *, (tokens - budget) / budget::DOUBLE AS delta FROM measured),
c AS (SELECT library, name, tokens, CASE WHEN budget IS NULL THEN 'no-sections' WHEN tokens > cap THEN 'over-cap' WHEN delta > 0.1::DOUBLE THEN 'over-budget' WHEN delta < -0.1::DOUBLE THEN 'under-budget' END AS ck FROM s)
SELECT library, CASE WHEN ck = 'over-cap' THEN 'error' ELSE 'warning' END AS severity, ck AS "check", name AS subject, tokens::VARCHAR AS detail FROM c WHERE ck IS NOT NULL
UNION ALL SELECT library, CASE WHEN tokens > 4500 THEN 'error' ELSE 'warning' END, CASE WHEN tokens > 4500 THEN 'master-over-stop' ELSE 'master-over-budget' END, 'SKILL.md', tokens::VARCHAR FROM routers WHERE tokens > 4500 OR (tokens - budget) / budget::DOUBLE > 0.1::DOUBLE""",
    "library_layout": f"WITH {_FILES}, {_LAYOUT} SELECT {_VIOLATION} FROM layout",
    "library_frontmatter": f"WITH {_FILES}, {_SHORT} SELECT {_VIOLATION} FROM front",
    "library_links": f"WITH {_FILES}, {_REFS}, {_LINKS} SELECT {_VIOLATION} FROM links",
    "library_index": f"WITH {_FILES}, {_REFS}, {_INDEX} SELECT {_VIOLATION} FROM idx",
    "library_violations": f"WITH {_FILES}, {_MEASURED}, {_ROUTERS}, {_LAYOUT}, {_SHORT}, {_LINKS}, {_INDEX}, {_MASTER}, {_CHECKS} " + " UNION ALL ".join(f"SELECT {_VIOLATION} FROM {x}" for x in ("layout", "front", "links", "idx", "master", "checks")),
    "skill_audit": f"""WITH {_FILES}, {_FRONT} SELECT {_VIOLATION} FROM front UNION ALL SELECT library, 'warning', 'name-differs-from-directory', 'SKILL.md', 'skill' FROM fm
UNION ALL SELECT library, 'warning', 'long-body', 'SKILL.md', k::VARCHAR FROM (SELECT library, {tokens(_BODY_TEXT)} AS k FROM files WHERE path = 'SKILL.md') WHERE k > 12000""",
    "input_budget_gate": f"SELECT doc_id, k::BIGINT AS estimated_tokens, (sum(k) OVER (ORDER BY doc_id))::BIGINT AS read, sum(k) OVER (ORDER BY doc_id) <= 80000 AS within FROM (SELECT doc_id, {tokens('t')} AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "tokens_per_word": f"SELECT doc_id, tokens, items, CASE WHEN items > 0 THEN tokens / items::DOUBLE END AS per_item, CASE WHEN items > 0 THEN tokens / items::DOUBLE BETWEEN 50 AND 70 END AS in_band FROM (SELECT doc_id, {tokens('t')} AS tokens, ({words('t')} % 40)::INT AS items FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "fallback_chapters": rf"WITH {_ROWS} SELECT doc_id, line, t AS text FROM rows WHERE regexp_matches(t, '(?i)^\s*#*\s*(?:chapter\s+[0-9]+|第\s*[0-9三]+\s*章)') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 60",
    "candidates_shown": f"WITH {_ROWS}, {_CANDIDATES} SELECT doc_id, strategy, line, label, number FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, strategy ORDER BY line) <= 3",
    "token_gate": f"SELECT doc_id, k AS tokens, k > 1000 AS over FROM (SELECT doc_id, {tokens('t')} AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "code_tripwires": rf"WITH {_ROWS} SELECT doc_id, count(*) FILTER (t LIKE '    %')::INT AS code_lines, count(*) FILTER (regexp_matches(t, '^\s*\|.*\|.*\|'))::INT AS table_lines, count(*)::INT AS total_lines FROM rows GROUP BY doc_id",
    "natural_order": "SELECT p_partkey, p_size::VARCHAR AS chapter, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey)::INT AS place FROM part",
    "url_hosts": "SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]*)', 1)) AS host FROM pages",
    "decoded_documents": "SELECT doc_id, md5(text) AS digest FROM documents",
}
