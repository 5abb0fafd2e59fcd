"""DuckDB SQL of queries whose rules are long lists of patterns: built from the same lists, in SQL's own operators."""

from __future__ import annotations

import hashlib
import hmac

from deskloom.functions import events as E
from deskloom.functions import prose
from deskloom.functions import values as V
from deskloom.operators import ledger
from deskloom.plans import aggregates_and_joins as A
from deskloom.plans import text_and_pages as T
from deskloom.plans.registry import SQL


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _met(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, {_quoted('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def _listed(cases: list[tuple[str, str]]) -> str:
    """The list of the names whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {condition} THEN {_quoted(name)} END" for name, condition in cases) + "], lambda x: x IS NOT NULL)"


def _tags(column: str, table: dict[str, list[str]], kind: str = "") -> str:
    return _listed([(kind + tag, _met(column, patterns)) for tag, patterns in table.items()])


# Local days, in whole seconds of UTC.
SQL["p02_local_day_window"] = """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
w AS (SELECT day, epoch(timezone('America/New_York', CAST(day AS TIMESTAMP) - INTERVAL 19 HOUR)) AS a, epoch(timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR)) AS b FROM d)
SELECT day, CAST(a AS BIGINT) AS start_s, CAST(b AS BIGINT) AS end_s, (b - a) / 3600 AS hours FROM w"""

# T01 on raw html; the pages have no numeric references.
_CLEAN = "html"
for _pattern, _put in (
    (r"(?is)<!\[CDATA\[(.*?)\]\]>", r"\1"), (r"(?i)&(?:nbsp|#160);", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&apos;", "'"),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", " "), (r"(?is)<style\b[^>]*>.*?</style\s*>", " "), (r"<[^>]+>", " "), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (r"\s+", " "), ("^ | $", ""),
):
    _CLEAN = f"regexp_replace({_CLEAN}, {_quoted(_pattern)}, {_quoted(_put)}, 'g')"
SQL["t01_clean_text_raw"] = f"SELECT page_id, {_CLEAN} AS text FROM pages"

# The article region, its plain text, its blocks.
_BARE = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in "script style nav footer header aside form svg noscript".split():
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_REGION = f"""r AS (SELECT page_id, CASE WHEN strlen(html) > 600000 OR len(html) - len(replace(html, '<', '')) > 12000 THEN '' WHEN regexp_extract(x, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) <> ''
THEN regexp_extract(x, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) ELSE regexp_extract(x, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1) END AS t FROM (SELECT page_id, html, {_BARE} AS x FROM pages))"""


def _plain(column: str) -> str:
    out = f"regexp_replace({column}, '(?s)<[^>]+>', ' ', 'g')"
    for name, put in (("nbsp", " "), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("amp", "&")):
        out = f"regexp_replace({out}, '(?i)&{name};', {_quoted(put)}, 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '[\\p{{Cc}}\\p{{Cf}}]', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


SQL["t02_article_plain_text"] = f"WITH {_REGION} SELECT page_id, {_plain('t')} AS text FROM r"
_OPEN = "(?i)<(?:p|h[1-4]|li)\\b[^>]*>"
SQL["s08_article_blocks"] = f"""WITH {_REGION}, b AS (SELECT page_id, list_transform(string_split_regex(t, '{_OPEN}')[2:], lambda x: {_plain("regexp_extract(x, '(?is)^(.*?)(?:</(?:p|h[1-4]|li)\\s*>|$)', 1)")}) AS b FROM r)
SELECT page_id, array_to_string(list_filter(b, lambda x: len(x) > 30 AND NOT regexp_matches(x, {_quoted(V.NO_TEXT)})), chr(10)) AS blocks FROM b"""

# Sentences, then those that may stand as an excerpt.
SQL["t20_safe_excerpt"] = """WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, regexp_replace(list_filter(s, lambda x: len(regexp_extract_all(x, '[\\p{L}\\p{N}]+')) BETWEEN 1 AND 12 AND len(x) <= 160 AND NOT regexp_matches(x, '(?i)https?://|www\\.') AND NOT regexp_matches(x, '["“”«»]')
AND NOT regexp_matches(x, '[?:;…]\\s*$') AND NOT regexp_matches(x, '(?i)^(?:ignore|click|subscribe|you must|please|do not)\\b'))[1], '[.!]+\\s*$', '') AS excerpt FROM s"""

# One literal phrase, as whole words, once.
SQL["t24_phrase_edits"] = """WITH f AS (SELECT doc_id, text, regexp_extract(text, '^([^\\n.]+)', 1) AS f FROM documents), n AS (SELECT *, len(regexp_extract_all(f, '[\\p{L}\\p{N}]+')) AS few, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS many FROM f)
SELECT doc_id, CASE WHEN len(f) > 0 AND len(text) - len(replace(text, f, '')) = len(f) AND NOT regexp_matches(substr(text, len(f) + 1, 1), '[\\p{L}\\p{M}\\p{N}_''’-]') AND few <= least(8, floor(many * 0.25)) AND f <> 'edited'
THEN replace(text, f, 'edited') END AS text FROM n"""

# The tags of planted headlines.
_TITLES = f"""d AS (SELECT doc_id, CAST(unnest([0, 1]) AS BIGINT) AS side, array_to_string(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+')[1:8], ' ') AS subject FROM documents),
h AS (SELECT 2 * doc_id + side AS item, 'Google ' || subject || ' ' || {T._ENDS!r}[2 * (doc_id % {len(T._ENDS) // 2}) + side + 1] AS title FROM d),
t AS (SELECT item, title, lower(title) AS t FROM h)"""
_OBJECTS, _LAST = _tags("t", E.OBJECTS), _tags("t", E.LAST_OBJECTS)
_ENTITIES = _tags("t", {k: [r"\b" + r"\s+".join(n.lower().replace(".", r"\.").split()) + r"\b" for n in names] for k, names in E.ENTITIES.items()})
_VERSIONS = ", ".join(f"list_transform(regexp_extract_all(t, {_quoted(p)}, 1), lambda x: 'version:{k}:' || x)" for k, patterns in E.VERSIONS.items() for p in patterns)
_PRODUCTS = f"list_concat({_tags('t', E.NAMED, 'named:')}, {_tags('t', E.FEATURES, 'feature:')}, {_tags('t', E.UNITS, 'unit:')}, {_tags('t', E.COMPONENTS, 'component:')}, {_VERSIONS}, list_transform(list_filter(regexp_extract_all(title, '\\b[A-Z][A-Z0-9]{{1,9}}\\b'), lambda x: NOT list_contains({E.ACRONYM_NOISE!r}, x)), lambda x: 'acronym:' || lower(x)))"
_STAGE = "CASE " + " ".join(f"WHEN {_met('t', [p])} THEN '{name}'" for name, p in E.STAGES) + " END"
SQL["c02_event_tags"] = f"""WITH {_TITLES} SELECT item, array_to_string({_tags('t', E.ACTIONS)}, ',') AS actions, array_to_string({_tags('t', E.ARTIFACTS)}, ',') AS artifacts,
array_to_string(CASE WHEN len({_OBJECTS}) > 0 THEN {_OBJECTS} ELSE ({_LAST})[1:1] END, ',') AS objects, array_to_string({_tags('t', E.LIFECYCLE)}, ',') AS lifecycle, array_to_string({_tags('t', E.FACETS)}, ',') AS facets,
array_to_string(list_sort(list_distinct({_PRODUCTS})), ',') AS products, array_to_string({_ENTITIES}, ',') AS entities, {_STAGE} AS stage, array_to_string(list_sort({_tags('t', V.POLARITY)}), ',') AS polarity FROM t"""

# Vetoes over planted titles and summaries.
_IDS = r"\b(?:CVE-\d{4}-\d{4,}|GHSA-[a-z0-9-]{8,})\b"
_HEAD, _ALL = "title || ' news'", "title || ' ' || summary || ' news'"
_VETO = {code: _met(f"regexp_replace({_HEAD}, {_quoted('(?i)' + V.SAFE_REVIEW)}, '', 'g')" if code.startswith("REVIEW") else _HEAD, patterns) for code, patterns in V.VETOES.items()}
_VETO["PROMOTIONAL_OR_DEAL_CONTENT"] += f" OR {_met(_ALL, [V.SPONSORED])}"
_VETO["SPECULATIVE_OR_RUMOR"] += f" OR {_met(_HEAD, [V.SOFT_SPECULATION])}"
_VETO["ROUTINE_CLOUD_CAPACITY_NOTICE"] += f" AND NOT ({_met(_ALL, [*V.BROAD_IMPACT, *V.BROAD_QUANTITY, _IDS])})"
_VETO["OPINION_OR_COMMENTARY"] = _met("title", [V.OPINION_TITLE])
_RAW = T._PLANTED.replace("lower(w ||", "(w ||").replace("lower(text ||", "(text ||")
SQL["p05_content_vetoes"] = _RAW + f"SELECT doc_id, array_to_string(list_sort({_listed(list(_VETO.items()))}), ',') AS reasons FROM x"

# Damage to a paragraph.
_KEYS = "|".join(prose.SCHEMA_KEYS)
_SCHEMA = rf"""(?i)["'](?:{_KEYS})["']\s*:|["'][A-Za-z_][A-Za-z0-9_]{{0,63}}["']\s*:\s*(?:["'\[{{]|-?\d|true\b|false\b|null\b)"""
_CITED = r"(?i)[(\[]\s*(?:(?:sources?|evidence|passages?)\s*:?\s*)?S[12]P[1-9]\d*(?:\s*[,;]\s*S[12]P[1-9]\d*)*\s*[)\]]"
SQL["p12_prose_codes"] = f"""WITH a AS (SELECT doc_id, trim(text) AS t, regexp_replace(regexp_replace(trim(text), '[“”„‟]', '"', 'g'), '[‘’‚‛]', '''', 'g') AS p FROM documents),
b AS (SELECT *, regexp_replace(p, '["'')\\]»\\s]+$', '') AS e FROM a)
SELECT doc_id, array_to_string({_listed([
    ("READER_PROSE_TYPE", "t IS NULL"), ("READER_PROSE_EMPTY", "t = ''"), ("READER_PROSE_SCHEMA_FRAGMENT", f"regexp_matches(p, {_quoted(_SCHEMA)})"),
    ("READER_PROSE_STRUCTURE", "regexp_matches(p, '(?:[}\\]]\\s*){2,}|\\[\\s*\\{|\\}\\s*,\\s*\\{|(?:^|\\n)\\s*```')"), ("READER_PROSE_INTERNAL_CITATION", f"regexp_matches(p, {_quoted(_CITED)})"),
    ("READER_PROSE_INCOMPLETE", "t <> '' AND (NOT regexp_matches(e, '[.!?]$') OR regexp_matches(e, '(?:\\.{2,}|…)$'))"),
    ("READER_PROSE_DANGLING_ENDING", f"regexp_matches(e, '(?i)\\b(?:{prose.DANGLING})[.!?]$')"), ("READER_PROSE_UNBALANCED_QUOTE", "len(regexp_replace(p, '[^\"]', '', 'g')) % 2 = 1"),
])}, ',') AS codes FROM b"""


# Desks and scorecards of planted titles and summaries.
def _strong(column: str, desk: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({column}, '{T._sql_term(t)}') THEN 1 ELSE 0 END" for t, w in V.DESK_TERMS[desk].items() if w >= V.STRONG_WEIGHT)


_DESK = ", ".join(f"{_strong('title', d)} AS t{i}, {_strong('summary', d)} AS s{i}, round({T._sql_sum('title', d, '1.35')} + {T._sql_sum('summary', d, '0.55')}, 2) AS c{i}" for i, d in enumerate(V.DESK_TERMS))
_FIT = {d: f"(t{i} >= 1 OR s{i} >= 2)" for i, d in enumerate(V.DESK_TERMS)}
_PLACE = {d: i for i, d in enumerate(V.DESK_TERMS)}
_LISTING = _met("title", [r"\b(?:ipo|initial public offering|go(?:ing)? public)\b"])
_JOINED = _met("title", [r"\b(?:integration|integrates?|available (?:on|in))\b"]) + " AND " + _met("title", [r"\b(?:vercel|developer|ide|editor)\b"])
_SECURE = f"t{_PLACE['security-and-privacy']} = 0"
_BEST = "list_max([" + ", ".join(f"CASE WHEN {f} THEN c{_PLACE[d]} END" for d, f in _FIT.items()) + "])"
SQL["d08_desk_choice"] = T._PLANTED + f""", y AS (SELECT doc_id, title, {_DESK} FROM x) SELECT doc_id, CASE WHEN NOT ({' OR '.join(_FIT.values())}) THEN NULL
WHEN {_SECURE} AND {_LISTING} AND {_FIT['platforms-and-power']} THEN 'platforms-and-power' WHEN {_SECURE} AND NOT {_LISTING} AND {_JOINED} AND {_FIT['work-and-tools']} THEN 'work-and-tools'
{' '.join(f"WHEN {f} AND c{_PLACE[d]} = {_BEST} THEN '{d}'" for d, f in _FIT.items())} END AS desk FROM y"""
_S = "security-and-privacy"
_KNOWN, _AMOUNT = f"CASE WHEN {_met('t', [_IDS])} THEN 1 ELSE 0 END", f"CASE WHEN {_met('t', V.BROAD_QUANTITY)} THEN 1 ELSE 0 END"
SQL["d09_scorecard"] = T._PLANTED + f""", y AS (SELECT doc_id, title || ' ' || summary AS t, {_strong('title', _S)} AS a, {_strong('summary', _S)} AS b, {T._sql_sum('title', _S, '1.35')} + {T._sql_sum('summary', _S, '0.55')} AS c FROM x),
z AS (SELECT doc_id, least(30, 8 + least(16, ({T._sql_count(V.IMPACT)}) * 4) + least(4, ({T._sql_count(V.NOVELTY)}) * 2) + {_KNOWN} * 3 + {_AMOUNT} * 2) AS materiality,
least(20, 10 + least(6, a * 3) + least(4, b * 2) + CASE WHEN round(c, 2) >= 35 THEN 2 ELSE 0 END) AS relevance, 20 AS strength, least(15, 4 + least(7, ({T._sql_count(V.ACTION)}) * 2) + {_KNOWN} * 2 + {_AMOUNT} * 2) AS usefulness, 13 AS freshness FROM y)
SELECT doc_id, CAST(materiality AS INTEGER) AS materiality, CAST(relevance AS INTEGER) AS relevance, strength, CAST(usefulness AS INTEGER) AS usefulness, freshness, CAST(least(100, materiality + relevance + strength + usefulness + freshness) AS INTEGER) AS score FROM z"""


# HMAC by its definition, on the ledger's derived key.
def _hmac(message: str) -> str:
    key = hmac.new(A.KEY, b"ledger:v2\0key", hashlib.sha256).digest().ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in key) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


assert ledger.derived_key(A.KEY, "ledger:v2") == hmac.new(A.KEY, b"ledger:v2\0key", hashlib.sha256).digest()
_TITLE = f"list_slice(list_sort(list_distinct(list_filter(list_transform({T._TOKENS.format('c_name')}, lambda x: {T._ALIAS}), lambda x: len(x) > 1 AND NOT regexp_matches(x, '^[0-9]{{4}}$')))), 1, 12)"
SQL["x01_keyed_fingerprints"] = f"""SELECT c_custkey, {_hmac("'ledger:v2:entity' || chr(0) || lower(c_name)")} AS entity, array_to_string(list_sort(list_transform({_TITLE}, lambda w: {_hmac("'ledger:v2:title-token' || chr(0) || w")})), ',') AS tokens FROM customer"""
