"""Operator 8: main text of HTML pages, by the repeated suffixes of a host's pages and the pages' own marks.

A page is read once, into blocks, each in one of three zones: ARTICLE (within an article or main element), OTHER (within an
element that holds no article by its kind, as menus, page headers, footers, sidebars and forms, or by its name, as adverts,
notices and comments), OPEN (the rest). The blocks that are not in an ARTICLE make the page's token stream.

The suffixes of a host's streams are compared by their first SPAN tokens, which finds the same repeats as whole suffixes, since
a longer repeat begins with a shorter one at each of its places. This is the sorted part of a suffix array, made in pieces:
each task sorts the suffixes of a slice of pages by prefix doubling, and gives one row for each distinct one; equal suffixes of
a host then meet by their hashes, so no task holds a host and no array of a whole host is built. A suffix that two distinct
pages of a host have is a substring that repeats across pages, and the tokens it covers are boilerplate.

What repetition covers is removed from OPEN and OTHER blocks. Of what it leaves, runs in OPEN blocks stay if the page marks no
article. Names and marks come first in and around articles: ARTICLE blocks stay whole, since articles share passages with each
other and repetition would remove article text, and OTHER blocks go even if they are unique (see the README for figures).

Names count as whole words of a class, id or role: `sidebar` and `site-footer` are names, `with-sidebar` is not. An article or
main element within an element of such a name begins an article all the same, unless the name is that of adverts, comments or
related articles, or the element's kind or `hidden` excludes it. A header element within an article is the article's own: its
headings and paragraphs stay, the rest of it goes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, map_arrow, slices, utf8

#: Tokens of a repeated substring, at least; a shorter block that is no paragraph or heading counts as a whole.
SPAN = 10
#: Repeated suffixes that may be broadcast, of 8 bytes each; more of them are joined by a shuffle.
BROADCAST_SUFFIXES = 1_000_000
ARTICLE, OPEN, OTHER = 0, 1, 2
#: Zones while a page is read: CLOSED and NAMED blocks are OTHER in the end; HEADED ones, of an article's own header, are of the
#: article if they are running text.
CLOSED, NAMED, HEADED = OTHER, 3, 4

#: Elements whose text is never main text.
DROPPED = frozenset("head title nav header footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu".split())
#: Elements whose content is plain text up to their end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line: their tags do not part words.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of running text, whose blocks may be short without being a menu's entry.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What a start tag closes if it is the innermost open element but for those within a line; every such tag closes a paragraph.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}} | dict.fromkeys(HEADINGS, HEADINGS)
#: Words of a class, id or role that name something other than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "aside widget header masthead footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share sharing social "
    "related recommended comment comments reply replies respond disqus pagination pager toolbar complementary contentinfo".split()
)
#: Words that may stand beside them in one class without changing what it names; numbers may too.
BESIDE = frozenset(
    "area bar block bottom box button buttons center col column container cta desktop fixed floating form frame global google group holder icon icons inline inner "
    "item items label large leaderboard left link links list main middle mobile mpu panel placeholder primary right row secondary section site slot small sticky "
    "strip text thread title top unit wrap wrapper zone".split()
)
#: Words that may stand beside a name if it isn't that of a title's place.
OWNERS = frozenset("article blog entry page post reader story user".split())
TITLED = frozenset("header masthead banner".split())
#: Names of what holds no article, whatever elements it has; `sidebar` and `aside` only as a word by themselves.
NOT_AN_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus related recommended".split())
ALONE = frozenset(["sidebar", "aside"])
MAIN = frozenset(["article", "main"])

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def _attributes(text: str) -> dict[str, str]:
    """Names and values of a start tag; of a name that comes twice, the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _named(word: str) -> int | None:
    """CLOSED or NAMED if a whole word of a class, id or role names something other than the article, else None."""
    parts = [p.lower() for p in _PARTS.findall(word)]
    names = [p for p in parts if p in NAMES]
    if not names:
        return None
    beside = BESIDE if TITLED.intersection(names) else BESIDE | OWNERS
    if any(p not in NAMES and p not in beside and not p.isdigit() for p in parts):
        return None
    return CLOSED if NOT_AN_ARTICLE.intersection(names) or (len(parts) == 1 and parts[0] in ALONE) else NAMED


def _excluded(name: str, attributes: dict[str, str]) -> int | None:
    """CLOSED if an element holds no article whatever is in it, NAMED if only an article within it is one, else None."""
    if name in DROPPED:
        return CLOSED
    if not attributes or name in ("html", "body"):
        return None
    if "hidden" in attributes or _UNSEEN.search(attributes.get("style", "")):
        return CLOSED
    words = [w for key in ("class", "id", "role") for w in attributes.get(key, "").split() if name not in MAIN or w.lower() not in ALONE]
    found = [_named(w) for w in words]
    if CLOSED in found:
        return CLOSED
    return NAMED if NAMED in found and name not in MAIN else None


def _decoded(text: str) -> str:
    """Character references read, white space as single spaces; references beyond Unicode, however long, are U+FFFD."""
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return " ".join(entities.unescape(text).split())


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose attributes begin at `at`; -1 if it never does. Quotes count after an equals sign only."""
    while True:
        stop = _STOP.search(html, at)
        if stop is None:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = html.find(stop[0][-1], stop.end()) + 1
        if not at:
            return -1


class _Page:
    """Reads one page; time and memory are in proportion to its length, whatever its markup."""

    def __init__(self):
        self.blocks: list[tuple[int, bool, str]] = []
        self.has_mark = False
        self.open: list[tuple[str, int]] = []  # elements with their zones; those within a line only where one changed the zone
        self.outer: list[int] = []  # which of them are not within a line
        self.count: Counter = Counter()  # open elements by name; those within a line by how many others are open around them
        self.zone = OPEN
        self.text: tuple[list[str], ...] = ([], [], [], [], [])

    def cut(self) -> None:
        """Ends the block."""
        prose = bool(self.outer) and self.open[self.outer[-1]][0] in PROSE
        for zone, pieces in enumerate(self.text):
            if pieces:
                if found := _decoded("".join(pieces)):
                    last = zone if zone < NAMED else ARTICLE if zone == HEADED and prose else OTHER
                    self.blocks.append((last, prose, found))
                pieces.clear()

    def _key(self, name: str):
        return (name, len(self.outer)) if name in INLINE else name

    def pop(self) -> str:
        name = self.open.pop()[0]
        if self.outer and self.outer[-1] == len(self.open):
            self.outer.pop()
        self.count[self._key(name)] -= 1
        self.zone = self.open[-1][1] if self.open else OPEN
        return name

    def start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name not in INLINE:
                self.cut()
            return
        if name in INLINE:
            other = self.zone != CLOSED and attributes and _excluded(name, _attributes(attributes)) is not None
            if other or (self.open and self.open[-1][0] in INLINE):
                self.zone = CLOSED if other else self.zone
                self.open.append((name, self.zone))
                self.count[self._key(name)] += 1
            return
        self.cut()
        while self.outer and ((inner := self.open[self.outer[-1]][0]) == "p" or inner in CLOSES.get(name, ())):
            depth = self.outer[-1]
            while len(self.open) > depth:
                self.pop()
        if attributes.endswith("/"):
            return
        if self.zone != CLOSED:
            own = _attributes(attributes) if attributes else {}
            held = _excluded(name, own)
            if name == "header" and self.zone in (ARTICLE, HEADED) and _excluded("div", own) is None:
                self.zone = HEADED
            elif held == CLOSED:
                self.zone = CLOSED
            elif name in MAIN or own.get("role", "").lower() in MAIN:
                self.zone, self.has_mark = ARTICLE, True
            elif held == NAMED:
                self.zone = NAMED
        self.outer.append(len(self.open))
        self.open.append((name, self.zone))
        self.count[name] += 1

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.cut()
        if self.count[self._key(name)]:
            while self.pop() != name:
                pass

    def read(self, html: str) -> None:
        at, n, closed_later = 0, len(html), True
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.text[self.zone].append(html[at:lt])
            mark = html[lt + 1 : lt + 2]
            if lt == n:
                break
            if html.startswith("<!--", lt):
                at = html.find("-->", lt + 2) + 3
                at = at if at > 2 else n
            elif closed_later and html.startswith("<![CDATA[", lt) and (at := html.find("]]>", lt + 9)) >= 0:
                self.text[self.zone].append(html[lt + 9 : at].replace("&", "&amp;"))
                at += 3
            elif mark and (mark in "!?" or (mark == "/" and not html[lt + 2 : lt + 3].isalpha())):
                closed_later &= not html.startswith("<![CDATA[", lt)  # none closes from here on
                at = html.find(">", lt + 1) + 1 or n
            elif found := _NAME.match(html, lt + (2 if mark == "/" else 1)):
                at = _tag_end(html, found.end())
                if at < 0:
                    break
                name, attributes, at = found[0].lower(), html[found.end() : at], at + 1
                if mark == "/":
                    self.end(name)
                elif name in RAW:
                    self.cut()
                    close = RAW[name].search(html, at)
                    at = close.end() if close else n
                else:
                    self.start(name, attributes)
            else:
                self.text[self.zone].append("<")
                at = lt + 1
        self.cut()


def blocks(html: str) -> tuple[list[tuple[int, bool, str]], bool]:
    """(zone, whether it is running text, text) of each block of a page in its order; and whether the page marks an article.

    Nested, unclosed and stray tags are borne. As in HTML, a comment or tag that never ends takes the rest of the page with
    it, and a `<` that begins no tag is text.
    """
    page = _Page()
    page.read(html)
    return page.blocks, page.has_mark


class Suffixes:
    """The suffixes of the streams of some pages, truncated at SPAN tokens and sorted by prefix doubling.

    pages are (host, blocks). at has the page, block and first token of each suffix that may cover tokens; own is its place
    among the distinct ones by host; hashes has the 64-bit hash of each distinct one with its host, equal in all tasks.
    """

    def __init__(self, pages: list[tuple[str, list[tuple[int, bool, str]]]], span: int = SPAN):
        import xxhash

        words: list[str] = []
        at: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        for p, (_, own) in enumerate(pages):
            for b, (zone, prose, text) in enumerate(own):
                if zone == ARTICLE:
                    continue
                tokens = text.split(" ")
                n = len(tokens)
                if n >= span or not prose:
                    k = np.arange(max(1, n - span + 1))
                    starts.append(len(words) + k)
                    at.append(np.stack([np.full(len(k), p), np.full(len(k), b), k], 1))
                    words += tokens
                    words += [""] * (span - n)  # a short block is a suffix by itself
        if not at:
            self.at, self.own, self.hashes = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        self.at, start = np.concatenate(at), np.concatenate(starts)
        names = {w: i for i, w in enumerate(sorted(set(words)))}
        rank = np.fromiter((names[w] for w in words), np.int64, len(words))
        done, order, size = None, rank, 1  # ranks by the first `size` tokens; done: by the tokens taken so far
        taken = 0
        while True:
            if span & size:
                done = order if done is None else _joined(done, order, taken)
                taken += size
            if 2 * size > span:
                break
            order = _joined(order, order, size)
            size *= 2
        hosts = {h: i for i, h in enumerate(dict.fromkeys(h for h, _ in pages))}
        host = np.array([hosts[h] for h, _ in pages])[self.at[:, 0]]
        _, first, self.own = np.unique(host * (len(words) + 1) + done[start], return_index=True, return_inverse=True)
        digest = xxhash.xxh64_intdigest
        text = (f"{pages[self.at[i, 0]][0]}\n{' '.join(words[start[i] : start[i] + span])}" for i in first)
        self.hashes = np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in text), np.uint64, len(first)).view(np.int64)


def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of pairs: a's rank at each place with b's `shift` places on."""
    after = np.zeros_like(b)
    after[: len(b) - shift] = b[shift:] + 1
    return np.unique(a * (int(b.max()) + 2) + after, return_inverse=True)[1]


def judged(page: list[tuple[int, bool, str]], has_mark: bool, covered: list[tuple[int, int]], span: int = SPAN) -> tuple[str, int, int]:
    """A page's main text; how many tokens repetition removed, and how many of those it left were dropped by name or place."""
    gone: dict[int, np.ndarray] = {}
    for b, k in covered:
        if b not in gone:
            gone[b] = np.zeros(page[b][2].count(" ") + 1, bool)
        gone[b][k : k + span] = True
    out, repeated, named = [], 0, 0
    for b, (zone, _, text) in enumerate(page):
        flags = gone.get(b)
        hit = 0 if flags is None else int(flags.sum())
        repeated += hit
        if zone == ARTICLE:
            out.append(text)
        elif zone == OTHER or has_mark:
            named += text.count(" ") + 1 - hit
        elif not hit:
            out.append(text)
        elif run := " ".join(t for t, f in zip(text.split(" "), flags, strict=True) if not f):
            out.append(run)
    return " ".join(out), repeated, named


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated, n_named) for each row; null html is empty, text is empty if nothing is left.

    n_repeated counts the tokens outside articles that were removed because they repeat on the host, n_named those that only
    their element's kind, name or place dropped. Pages of a host with equal texts count as one, so copies of a page do not
    remove each other's text. A page without a url is of the host ''. Rows that repeat others each get a row; pages of any
    length are read whole; an empty table gives an empty table; extra columns are not carried, whatever their names.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), utf8(html).alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_repeated"), F.lit(0).cast("long").alias("n_named")).schema
    read_schema = rows.select("page_id", "url", "host", F.lit(True).alias("has_mark"), F.array(F.lit(0)).alias("kinds"), F.array(F.lit("")).alias("texts")).schema

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(x) for x in batch.column(3).to_pylist()]
        kinds = [[zone * 2 + prose for zone, prose, _ in own] for own, _ in found]
        columns = [pa.array([m for _, m in found], pa.bool_()), pa.array(kinds, pa.list_(pa.int32())), pa.array([[t for _, _, t in own] for own, _ in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=read_schema.names)

    pages = checkpointed(map_arrow(rows, read, read_schema))  # each page is parsed once

    def of(kinds: pa.Array, texts: pa.Array) -> list[list[tuple[int, bool, str]]]:
        return [[(k >> 1, bool(k & 1), t) for k, t in zip(x, y, strict=True)] for x, y in zip(kinds.to_pylist(), texts.to_pylist(), strict=True)]

    def sorted_suffixes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        import xxhash

        streams = list(zip(batch.column(0).to_pylist(), of(batch.column(1), batch.column(2)), strict=True))
        found = Suffixes(streams)
        if not len(found.hashes):
            return None
        page = np.array([xxhash.xxh64_intdigest("\n".join(t for _, _, t in own).encode("utf-8", "surrogatepass")) for _, own in streams], np.uint64).view(np.int64)[found.at[:, 0]]
        low, high = np.full(len(found.hashes), np.iinfo(np.int64).max), np.full(len(found.hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, found.own, page)
        np.maximum.at(high, found.own, page)
        return pa.RecordBatch.from_arrays([pa.array(found.hashes), pa.array(low), pa.array(high)], names=["suffix", "low", "high"])

    merged = map_arrow(pages.select("host", "kinds", "texts"), sorted_suffixes, "suffix long, low long, high long").groupBy("suffix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    repeated = checkpointed(merged.where("low < high").select("suffix"))

    def decided(batch: pa.RecordBatch, known) -> pa.RecordBatch:
        """known(i, hashes): which of the hashes of suffixes repeat, for the i-th row."""
        streams, marks = of(batch.column(4), batch.column(5)), batch.column(3).to_pylist()
        found = Suffixes(list(zip(batch.column(2).to_pylist(), streams, strict=True)))
        edges = np.searchsorted(found.at[:, 0], np.arange(len(streams) + 1))
        out = []
        for i, (own, has_mark) in enumerate(zip(streams, marks, strict=True)):
            part = slice(edges[i], edges[i + 1])
            hit = known(i, found.hashes[found.own[part]])
            out.append(judged(own, has_mark, found.at[part][hit][:, 1:].tolist()))
        text, n, m = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["page_id", "url", "text", "n_repeated", "n_named"])

    if repeated.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES:
        shared = df.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column(0).to_numpy()))  # BROADCAST_SUFFIXES at most

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = shared.value
            at = lambda hashes: np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            return decided(batch, lambda i, hashes: known[at(hashes)] == hashes if len(known) else np.zeros(len(hashes), bool))

        out = map_arrow(pages, run, schema)
    else:
        own = pages.withColumn("page", F.xxhash64("host", "kinds", "texts"))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = Suffixes(list(zip(part.column(1).to_pylist(), of(part.column(2), part.column(3)), strict=True)))
                    if len(found.own):
                        both = np.unique(np.stack([part.column(0).to_numpy()[found.at[:, 0]], found.hashes[found.own]], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["p", "suffix"])

        listing = own.select("page", "host", "kinds", "texts").mapInArrow(listed, "p long, suffix long")
        # by the suffix turned over, so that both sides are dealt out anew and a frequent suffix can be split
        met = listing.join(repeated.select(F.bitwise_not("suffix").alias("turned")), F.bitwise_not("suffix") == F.col("turned"), "left_semi")
        covered = met.groupBy("p").agg(F.collect_set("suffix").alias("covered"))  # of one page's text, so bounded by its length
        joined = own.join(covered, F.col("page") == F.col("p"), "left").select(*pages.columns, "covered")

        def run_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = batch.column(6).to_pylist()
            return decided(batch, lambda i, hashes: np.isin(hashes, np.array(sets[i] or [], np.int64)))

        out = map_arrow(joined, run_joined, schema)
    return out.select(F.col("page_id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_named")
