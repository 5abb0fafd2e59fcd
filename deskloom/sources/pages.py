"""Page scans (S08-S10): article blocks, structured units, and metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.prose import select_passages
from deskloom.functions.text import plain_text
from deskloom.functions.times import parse_instant

NOISE = "script|style|nav|footer|header|aside|form|svg|noscript"


#: Octets and tags of a page beyond which it is not read as an article.
MOST_OCTETS, MOST_TAGS = 600_000, 12_000


def article_region(html: Column, octets: int | None = MOST_OCTETS, tags: int | None = MOST_TAGS) -> Column:
    """The first article's content, else the first main's; empty without either.

    A page with more octets or tags than the limits is refused, as empty; with None for them, pages of any size are read.
    """
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, rf"(?is)<({NOISE})\b[^>]*>.*?</\1\s*>", " ")
    found = F.regexp_extract(x, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    found = F.when(found != "", found).otherwise(F.regexp_extract(x, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1))
    fine = F.lit(True)
    if octets is not None:
        fine &= F.octet_length(html) <= octets
    if tags is not None:
        fine &= F.regexp_count(html, F.lit("<")) <= tags
    return F.when(fine, found).otherwise("")


def article_blocks(html: Column, least: int = 30) -> Column:
    """Texts of paragraphs, headings and list items longer than so many characters, without calls to subscribe and the like."""
    block = r"(?is)<(?:p|h[1-4]|li)\b[^>]*>(.*?)(?=<(?:p|h[1-4]|li)\b|</(?:p|h[1-4]|li)\s*>|$)"
    texts = F.transform(F.regexp_extract_all(article_region(html), F.lit(block), F.lit(1)), plain_text)
    return F.filter(texts, lambda t: (F.length(t) > least) & ~t.rlike(V.NO_TEXT))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either kind of quotes or none; empty without it."""
    found = F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'=<>`]+))", 0)
    return F.regexp_replace(F.regexp_replace(found, rf"(?is)^\s*{name}\s*=\s*", ""), r"^[\"']|[\"']$", "")


# Types of JSON-LD nodes that are an article.
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle", "Report"]
_NODE = "struct<`@type`: string, datePublished: string, url: string, mainEntityOfPage: string>"


def metadata(html: Column) -> dict[str, Column]:
    """Titles, identities and publication dates, as arrays of all that a page's meta, link and JSON-LD elements state."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    plain = F.regexp_replace(bare, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    tags = lambda name: F.regexp_extract_all(plain, F.lit(rf"(?is)<{name}\b([^<>]*)>"), F.lit(1))
    about = F.transform(tags("meta"), lambda t: F.struct(F.lower(F.coalesce(F.nullif(_attribute(t, "property"), F.lit("")), _attribute(t, "name"))).alias("name"), plain_text(_attribute(t, "content")).alias("content")))
    meta = lambda name: F.transform(F.filter(about, lambda m: m["name"] == name), lambda m: m["content"])
    linked = F.transform(F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")), lambda t: plain_text(_attribute(t, "href")))
    scripts = F.regexp_extract_all(bare, F.lit(r"(?is)<script\b[^<>]*application/ld\+json[^<>]*>(.*?)</script\s*>"), F.lit(1))
    graph = lambda j: F.concat(F.array(F.from_json(j, _NODE)), F.coalesce(F.from_json(F.get_json_object(j, "$['@graph']"), f"array<{_NODE}>"), F.array().cast(f"array<{_NODE}>")))
    nodes = F.filter(F.flatten(F.transform(scripts, graph)), lambda n: F.regexp_replace(n["@type"], r"^https?://schema\.org/", "").isin(ARTICLE_TYPES))
    stated = lambda field: F.filter(F.transform(nodes, lambda n: n[field]), lambda x: x.isNotNull())
    region = article_region(html)
    return {
        "title": F.coalesce(F.get(meta("og:title"), F.lit(0)), plain_text(F.regexp_extract(region, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))),
        "titles": F.array_distinct(F.filter(meta("og:title"), lambda x: x != "")),
        "identities": F.array_distinct(F.concat(linked, meta("og:url"), stated("url"), stated("mainEntityOfPage"))),
        "dates": F.array_distinct(F.concat(meta("article:published_time"), stated("datePublished"))),
    }


def metadata_codes(html: Column, url: Column) -> Column:
    """What keeps a page from being admitted: the first of identity, date and title that fails."""
    m = metadata(html)
    instants = F.transform(m["dates"], parse_instant)
    code = (
        F.when(F.exists(m["identities"], lambda i: i != url), "ARTICLE_IDENTITY_CONFLICT")
        .when(F.size(m["dates"]) == 0, "PUBLICATION_DATE_MISSING")
        .when(F.exists(instants, lambda x: x.isNull()), "PUBLICATION_DATE_INVALID")
        .when(F.size(F.array_distinct(instants)) > 1, "PUBLICATION_DATE_CONFLICT")
        .when((F.length(m["title"]) == 0) | (F.length(m["title"]) > 240) | (F.size(m["titles"]) > 1), "ARTICLE_TITLE_INVALID")
    )
    return F.array_compact(F.array(code))


# Holds of a page whose text is not wholly accounted for, and patterns of texts that were cut or flattened.
HOLDS = [
    "RELATED_ARTICLE_NOT_PRIMARY", "ARTICLE_REGION_UNAVAILABLE", "NESTED_ARTICLE_REGION", "AMBIGUOUS_TABLE", "AMBIGUOUS_DEFINITION_LIST", "UNSUPPORTED_ARTICLE_TEXT_STRUCTURE",
    "ARTICLE_CONTENT_UNAVAILABLE", "EVIDENCE_EXTRACTION_INCOMPLETE", "ADVISORY_STRUCTURE_REVIEW", "REQUIRED_CONTEXT_EXCEEDS_BUDGET", "ARTICLE_CONTENT_INSUFFICIENT",
]
CUT = r"vers:intdot/|\bUpdate to V\d*\s*$|\b(?:obtain|install|download|update)[^.?!]*\b(?:the latest|the|to|and|version|release)\s*$"
FLATTENED = r"Countries/Areas Deployed:|CVSS\s+Vendor\s+Equipment\s+Vulnerabilities"
CRITICAL = r"\b(?:not|no|only|unless|requires?|must|except|if|when|affected|versions?|mitigations?|patch|fixed|limitations?|eligibility|rollout)\b"
TEASER = "c-teaser"
STRUCTURED_CHARS, STRUCTURED_PASSAGES, MOST_BLOCKS, LEAST_CHARS, MOST_ROWS, MOST_CELLS = 5_000, 32, 1_000, 120, 80, 12
_CUT, _FLATTENED, _CRITICAL = (re.compile(p, re.I | re.A) for p in (CUT, FLATTENED, CRITICAL))

_UNSEEN = re.compile("[\x00-\x1f\x7f-\x9f\xad\u200b-\u200f\u2028-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = (*_HEADINGS, "p", "li")
_ENDS = (*_BLOCKS, "article", "main", "div", "section")
_SPANNING = {"rowspan", "colspan", "scope", "headers"}


class _Account(HTMLParser):
    """A region's blocks in order; every text belongs to a block, a cell or a definition, or else to `loose`.

    Tables and definition lists are read whole: each is a list of (kind, text) cells by row, and a fault if any of its text lies
    outside of them or an element is not closed.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.path: list[str] = []
        self.loose: list[str] = []
        self.fault = ""
        self.kind = ""
        self.text: list[str] = []
        self.whole = ""
        self.rows: list[list[tuple[str, str]]] = []
        self.cell = ""
        self.in_row = False
        self.captions: list[str] = []
        self.stray = False
        self.seen: list[str] = []

    def heading(self) -> str:
        return " — ".join(filter(None, self.path))

    def taken(self) -> str:
        out, self.text = " ".join(_UNSEEN.sub(" ", "".join(self.text)).split()), []
        return out

    def failed(self) -> None:
        self.fault = self.fault or ("AMBIGUOUS_TABLE" if self.whole == "table" else "AMBIGUOUS_DEFINITION_LIST")

    def close_block(self) -> None:
        text, kind, self.kind = self.taken(), self.kind, ""
        if not text:
            return
        if kind in _HEADINGS:
            level = int(kind[1])
            self.path = [*(self.path + [""] * 6)[: level - 1], text]
            self.blocks.append(self.heading())
        else:
            self.blocks.append(" — ".join(filter(None, [self.heading(), text])))

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.whole:
            self._inside(tag, attrs)
        elif tag in ("table", "dl"):
            self.close_block()
            self.whole, self.rows, self.cell, self.in_row, self.captions, self.stray, self.seen = tag, [], "", False, [], False, []
            if tag == "table" and any(a in _SPANNING for a, _ in attrs):
                self.failed()
        elif tag in _BLOCKS:
            self.close_block()
            self.kind = tag
        elif tag in ("article", "main"):
            self.fault = self.fault or "NESTED_ARTICLE_REGION"
        else:
            self.text.append(" ")

    def _inside(self, tag: str, attrs) -> None:
        cells = ("td", "th", "caption") if self.whole == "table" else ("dt", "dd")
        if tag in ("table", "dl") and (tag == self.whole or self.whole == "dl"):
            self.failed()
        if self.whole == "table" and any(a in _SPANNING for a, _ in attrs):
            self.failed()
        if tag == "tr" and self.whole == "table":
            if self.in_row or self.cell:
                self.failed()
            self.in_row = True
            self.rows.append([])
        elif tag in cells:
            if self.cell or (tag in ("td", "th") and not self.in_row):
                self.failed()
            self.taken()
            self.cell = tag
        else:
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.whole:
            if self.kind and tag in _ENDS:
                self.close_block()
            else:
                self.text.append(" ")
        elif tag == self.cell:
            text, self.cell = self.taken(), ""
            if tag == "caption":
                self.captions.append(text)
            elif self.whole == "dl":
                self.rows.append([(tag, text)])
            elif self.rows:
                self.rows[-1].append((tag, text))
        elif tag == "tr" and self.whole == "table":
            if self.cell:
                self.failed()
            self.in_row = False
        elif tag == self.whole:
            if self.cell or self.in_row or self.stray:
                self.failed()
            units = self._table() if tag == "table" else self._definitions()
            if units is None:
                self.failed()
            self.blocks += units or []
            self.whole = ""
            self.taken()
        else:
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.whole:
            self.seen.append(data)
            if self.cell:
                self.text.append(data)
            elif data.strip():
                self.stray = True
        elif self.kind:
            self.text.append(data)
        else:
            self.loose.append(data)

    def _table(self) -> list[str] | None:
        """Units of rows under one row of headers, or of header and value pairs; None if the table is neither."""
        rows = self.rows
        if not rows or len(rows) > MOST_ROWS or len(self.captions) > 1 or any(not 1 <= len(row) <= MOST_CELLS for row in rows) or any(not text for row in rows for _, text in row):
            return None
        start = " — ".join(filter(None, [self.heading(), *self.captions]))
        start += " — " if start else ""
        distinct = lambda texts: len({t.lower() for t in texts}) == len(texts)
        names = [text for _, text in rows[0]]
        if all(kind == "th" for kind, _ in rows[0]) and distinct(names):
            plain = len(rows) > 1 and all(len(row) == len(names) and any(kind == "td" for kind, _ in row) and all(kind == "td" for kind, _ in row[1:]) for row in rows[1:])
            return [start + "; ".join(f"{n}: {text}" for n, (_, text) in zip(names, row, strict=True)) for row in rows[1:]] if plain else None
        if all([kind for kind, _ in row] == ["th", "td"] for row in rows) and distinct([row[0][1] for row in rows]):
            return [f"{start}{row[0][1]}: {row[1][1]}" for row in rows]
        return None

    def _definitions(self) -> list[str] | None:
        entries = [row[0] for row in self.rows]
        pairs = list(zip(entries[::2], entries[1::2], strict=False))
        if not entries or len(entries) % 2 or any((a, b) != ("dt", "dd") or not term or not meaning for (a, term), (b, meaning) in pairs):
            return None
        return [" — ".join(filter(None, [self.heading(), f"{term}: {meaning}"])) for (_, term), (_, meaning) in pairs]


def accounted(region: str, title: str) -> tuple[str, list[str], int, int]:
    """(hold, blocks, input blocks, omitted blocks) of an article's region: a hold, and no blocks, unless all of its text is accounted for.

    Blocks are the title, headings with those above them, and paragraphs, items, rows and definitions after their headings;
    beyond the budget those that matter most are kept, but none that states a condition is left out.
    """
    page = _Account()
    page.path, page.blocks = ([title], [title]) if title else ([], [])
    page.feed(region)
    page.close()
    page.close_block()
    if page.whole:
        page.loose += page.seen
        page.failed() if not "".join(page.seen).strip() else None
    if page.fault:
        return page.fault, [], 0, 0
    if "".join(page.loose).strip():
        return "UNSUPPORTED_ARTICLE_TEXT_STRUCTURE", [], 0, 0
    blocks = page.blocks
    if not 1 <= len(blocks) <= MOST_BLOCKS:
        return "ARTICLE_CONTENT_UNAVAILABLE", [], 0, 0
    texts = ["\n".join(blocks), *blocks]
    for hold, pattern in (("EVIDENCE_EXTRACTION_INCOMPLETE", _CUT), ("ADVISORY_STRUCTURE_REVIEW", _FLATTENED)):
        if any(pattern.search(t) for t in texts):
            return hold, [], 0, 0
    kept = select_passages(blocks, title, STRUCTURED_CHARS, STRUCTURED_PASSAGES, 1)
    if any(_CRITICAL.search(b) and b not in kept for b in blocks):
        return "REQUIRED_CONTEXT_EXCEEDS_BUDGET", [], 0, 0
    if len("\n".join(kept)) < LEAST_CHARS or len(kept) < 2:
        return "ARTICLE_CONTENT_INSUFFICIENT", [], 0, 0
    return "", kept, len(blocks), sum(b not in kept for b in blocks)


def structured_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, status, holds, blocks, input_blocks, omitted_blocks) for each page: usable with its blocks, or held with the reason.

    A page without a region, and a null, is held. Pages are read one by one, so a task holds one page beside its batch.
    """
    kind = dict(df.dtypes)[key]
    text = F.coalesce(F.col(html), F.lit(""))
    region = article_region(text)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    teaser = F.regexp_extract(bare, r"(?i)<article\b[^>]*>", 0).rlike(rf"(?is)\bclass\s*=\s*([\"'])[^\"']*\b{TEASER}\b[^\"']*\1")
    title = plain_text(F.regexp_extract(region, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    rows = df.select(key, region.alias("__region"), title.alias("__title"), F.when(teaser, HOLDS[0]).when(region == "", HOLDS[1]).alias("__hold"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, region, title, early in zip(batch[key], batch["__region"], batch["__title"], batch["__hold"], strict=True):
                hold, blocks, count, omitted = (early, [], 0, 0) if early else accounted(region, title)
                out.append((k, "held" if hold else "usable", [hold] if hold else [], blocks, count, omitted))
            yield pd.DataFrame(out, columns=[key, "status", "holds", "blocks", "input_blocks", "omitted_blocks"])

    return rows.mapInPandas(run, f"`{key}` {kind}, status string, holds array<string>, blocks array<string>, input_blocks int, omitted_blocks int")
