"""Checks of prose against its source."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.text import let

# Keys of the internal schema that prose must not show.
SCHEMA_KEYS = [
    "candidateId", "headline", "deck", "claims", "supports", "evidenceId", "whatHappened", "whyItMatters", "whatToDoOrWatch",
    "stories", "reviews", "draftSha256", "factsSupported", "attributionAccurate", "analysisSupported", "usefulAndSpecific", "sourceIds", "sources", "editorialPayload", "text",
]
# Words that a summary must not add to its source, and words that prose may begin with a capital anywhere.
HIGH_RISK_TERMS = [
    "acquire", "acquired", "acquires", "acquiring", "acquisition", "acquisitions", "attack", "attacked", "attacks", "ban", "banned", "bans",
    "billion", "billions", "breach", "breached", "breaches", "buy", "buying", "bought", "compromise", "compromised", "compromises", "critical",
    "exploit", "exploited", "exploiting", "exploits", "expose", "exposed", "exposes", "fine", "fined", "fines", "fire", "fired", "fires", "global",
    "launch", "launched", "launches", "launching", "layoff", "layoffs", "lawsuit", "lawsuits", "leak", "leaked", "leaks", "million", "millions",
    "merger", "mergers", "own", "owned", "ownership", "owns", "patch", "patches", "purchase", "purchased", "purchases", "ransomware", "regulation",
    "regulations", "release", "released", "releases", "ruling", "rulings", "shutdown", "steal", "stealing", "stolen", "sue", "sued", "sues",
    "trillion", "trillions", "vulnerability", "vulnerabilities", "worldwide", "zero-day",
]
SAFE_CAPITALIZED = [
    "a", "after", "an", "before", "cautious", "check", "compare", "for", "independent", "keep", "no", "only", "open", "read", "readers", "reviewed",
    "source", "teams", "the", "this", "treat", "two", "watch",
]
# Endings that leave a sentence open.
DANGLING = "and|or|but|because|although|unless|whether|whereas|despite|including|such as|due to|as well as|in order to"
# What makes a passage a caveat, a detail, or dependent on the one before.
CAVEAT = r"\b(?:unless|provided that|requires?|prerequisites?|only (?:if|when|with|available|supported)|does not|has not|no (?:evidence|fixed|patch|fix|known)|not (?:available|supported|confirmed|established)|cannot|must|limited to|restricted to|except|availability|rollout|mitigations?|remediation|fixed in|patched in|secure boot|authentication|exploitation)\b"
DETAIL = r"\b(?:adds?|introduc(?:e[sd]?|ing)|supports?|changes?|enables?|allows?|permits?|releases?|launch(?:es|ed)?|available|versions?|regions?|customers?|users?|pricing|costs?|limits?|latency|performance|affected|driver|vulnerabilit(?:y|ies)|fix(?:es|ed)?|patch(?:es|ed)?)\b|\b\d+(?:\.\d+)+(?:\b)|\bCVE-\d{4}-\d+\b"
REFERENTIAL = r"^(?:it|they|these|those|this|that|such|however|unless|only if|when|if|without|availability|mitigation|remediation)\b"
CONDITIONAL = r"\b(?:when|if|without)\b"
# The budget of passages, for callers that give no smaller one.
PASSAGE_CHARS, PASSAGES = 5800, 40
PAGE_CHARS, PAGE_BLOCKS, TITLE_CHARS, TITLE_TERMS = 600_000, 6_000, 1_000, 24
# Words of a title that say nothing of its subject.
PASSAGE_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "can", "for", "from", "has", "have", "in", "into", "is", "it", "its", "new", "of", "on",
    "or", "our", "the", "their", "this", "to", "update", "updates", "was", "were", "will", "with", "your", "today", "reports", "report", "says", "said",
]
# Words around versions and what they say of the bound.
BOUNDS_BEFORE = {
    "lte": r"at\s+most|no\s+(?:later|newer|higher)\s+than|up\s+to\s+and\s+including|<=|≤", "gte": r"at\s+least|no\s+(?:earlier|older|lower)\s+than|>=|≥",
    "lt": r"below|under|(?:earlier|older|less|lower)\s+than|before|<", "gt": r"above|over|(?:later|newer|greater|higher)\s+than|after|>",
}
BOUNDS_AFTER = {"lte": r"(?:or|and)\s+(?:earlier|older|below|lower)", "gte": r"(?:or|and)\s+(?:later|newer|above|higher)"}


#: Characters of a text's end that decide how it ends, and how many of them must be left once closing marks are cut off.
TAIL, TAIL_LEFT = 1_000, 500


def _plain_quotes(text: Column) -> Column:
    for curly, straight in (("“”„‟", '"'), ("‘’‚‛", "'")):
        for c in curly:
            text = F.replace(text, F.lit(c), F.lit(straight))
    return text


def prose_codes(text: Column, paragraph: bool = False) -> Column:
    """Codes of damage to reader-facing text; a paragraph must also end like one.

    The text is prepared once. Plain searches for what a pattern can't do without come before it, and the end is judged by a
    tail, unless so much of that is closing marks that the whole text must be looked at.
    """
    t = F.trim(text)
    keys = "|".join(SCHEMA_KEYS)
    schema = rf"(?i)[\"'](?:(?:{keys})[\"']\s*:|[A-Za-z_][A-Za-z0-9_]{{0,63}}[\"']\s*:\s*(?:[\"'\[{{]|-?\d|true\b|false\b|null\b))"
    structure = r"(?:[}\]]\s*){2,}|\[\s*\{|\}\s*,\s*\{|(?:^|\n)\s*```"
    citation = r"(?i)[(\[]\s*(?:(?:sources?|evidence|passages?)\s*:?\s*)?S[12]P[1-9]\d*(?:\s*[,;]\s*S[12]P[1-9]\d*)*\s*[)\]]"
    some = lambda x, *signs: F.greatest(*[x.contains(s) for s in signs])
    closing = r"[\"')\]»\s]+$"

    def damage(x: Column) -> Column:
        out = [
            F.when(x == "", F.lit("READER_PROSE_EMPTY")),
            F.when(x.contains(":") & some(x, '"', "'") & x.rlike(schema), F.lit("READER_PROSE_SCHEMA_FRAGMENT")),
            F.when(some(x, "}", "]", "{", "```") & x.rlike(structure), F.lit("READER_PROSE_STRUCTURE")),
            F.when(some(x, "(", "[") & x.rlike(citation), F.lit("READER_PROSE_INTERNAL_CITATION")),
        ]
        return F.array_compact(F.array(*out))

    def ending(x: Column, end: Column) -> Column:
        out = [
            F.when((x != "") & (~end.rlike("[.!?]$") | end.rlike(r"(?:\.{2,}|…)$")), F.lit("READER_PROSE_INCOMPLETE")),
            F.when(end.rlike(rf"(?i)\b(?:{DANGLING})[.!?]$"), F.lit("READER_PROSE_DANGLING_ENDING")),
            F.when((F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))) % 2 == 1, F.lit("READER_PROSE_UNBALANCED_QUOTE")),
        ]
        return F.array_compact(F.array(*out))

    def whole(x: Column) -> Column:
        cut = let(F.regexp_replace(F.right(x, F.lit(TAIL)), closing, ""), lambda e: F.when(F.length(e) >= TAIL_LEFT, e).otherwise(F.regexp_replace(x, closing, "")))
        return F.concat(damage(x), let(cut, lambda end: ending(x, end)))

    found = let(_plain_quotes(t), whole if paragraph else damage)
    return F.when(text.isNull(), F.array(F.lit("READER_PROSE_TYPE"))).otherwise(found)


def note_valid(note: Column, category: Column) -> Column:
    """A note of 500 characters at most, trimmed, without controls, links or addresses; long enough where it is needed."""
    n = F.coalesce(note, F.lit(""))
    clean = ~n.rlike(r"[\x00-\x1f\x7f-\x9f]") & ~n.rlike(r"(?i)(?:https?://|www\.|mailto:)") & ~n.rlike(r"(?:^|\s)[^\s@]+@[^\s@]+\.[^\s@]+(?:$|\s)")
    return (F.length(n) <= 500) & (n == F.trim(n)) & clean & (~category.isin("missed_story", "correction") | (F.length(n) >= 8))


def lexical_forms(words: Column) -> Column:
    """Each lower-case word with what it may be an inflection of."""
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    one = lambda w: F.array_compact(
        F.array(
            w,
            F.when(w.rlike("['’]s$"), cut(w, 2)),
            F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))),
            F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1)),
            F.when((F.length(w) > 5) & w.endswith("ed"), cut(w, 2)),
            F.when((F.length(w) > 5) & w.endswith("ed"), cut(w, 1)),
            F.when((F.length(w) > 6) & w.endswith("ing"), cut(w, 3)),
            F.when((F.length(w) > 6) & w.endswith("ing"), F.concat(cut(w, 3), F.lit("e"))),
        )
    )
    return F.array_distinct(F.flatten(F.transform(words, one)))


def _forms(word: str) -> list[str]:
    """lexical_forms() of one word."""
    out = [word]
    if word.endswith(("'s", "’s")):
        out.append(word[:-2])
    if len(word) > 4 and word.endswith("ies"):
        out.append(word[:-3] + "y")
    if len(word) > 4 and word.endswith("s") and not word.endswith("ss"):
        out.append(word[:-1])
    if len(word) > 5 and word.endswith("ed"):
        out += [word[:-2], word[:-1]]
    if len(word) > 6 and word.endswith("ing"):
        out += [word[:-3], word[:-3] + "e"]
    return out


#: Every word that has a high-risk term among its forms.
_RISKY = sorted(
    {w for t in HIGH_RISK_TERMS for w in (t, *(t + e for e in ("'s", "’s", "s", "ed", "d", "ing")), t.removesuffix("y") + "ies", t.removesuffix("e") + "ing") if t in _forms(w)}
)


def all_forms(words: Column) -> Column:
    """lexical_forms() of distinct words, of which only those with an ending of an inflection are looked into."""
    ended = F.filter(words, lambda w: w.endswith("s") | w.endswith("ed") | w.endswith("ing"))
    return F.array_union(words, lexical_forms(ended))


def inflected(forms: Column) -> Column:
    """The words beside themselves that have one of the given words among their lexical_forms()."""
    long = lambda f, least: F.length(f) >= least
    cut = lambda f: F.substring(f, F.lit(1), F.length(f) - 1)
    one = lambda f: F.array_compact(
        F.array(
            F.concat(f, F.lit("'s")),
            F.concat(f, F.lit("’s")),
            F.when(long(f, 3) & f.endswith("y"), F.concat(cut(f), F.lit("ies"))),
            F.when(long(f, 4) & ~f.endswith("s"), F.concat(f, F.lit("s"))),
            F.when(long(f, 4), F.concat(f, F.lit("ed"))),
            F.when(long(f, 5) & f.endswith("e"), F.concat(f, F.lit("d"))),
            F.when(long(f, 4), F.concat(f, F.lit("ing"))),
            F.when(long(f, 5) & f.endswith("e"), F.concat(cut(f), F.lit("ing"))),
        )
    )
    return F.flatten(F.transform(forms, one))


def unsupported_names(output: Column, source: Column, cap: int = 8) -> Column:
    """Words of output none of whose forms source has, if they are high-risk terms, have capitals inside, or are capitalized
    within a sentence; sorted, lower case, the first few.

    Words are taken once each and compared by set operations alone: those that source lacks as they are go if they are an
    inflection of one of their forms that source has.
    """
    word = r"[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*"
    named = r"(?=\p{Lu})(?<![\p{L}\p{N}’'-])(?<!^)(?<![.!?…]\s{0,40})(\p{Lu}[\p{L}\p{N}]*(?:[’'-][\p{L}\p{N}]+)*)"
    every = lambda text, pattern, group: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    low = lambda words: F.array_distinct(F.transform(words, lambda w: F.lower(w)))
    listed = lambda words: F.split(F.lit(" ".join(words)), " ")

    def sought(raw: Column) -> Column:
        inside = F.filter(raw, lambda w: w.rlike(r"\p{Ll}\p{Lu}|\p{Lu}{2}"))
        capitals = F.array_except(low(every(output, named, 1)), listed(SAFE_CAPITALIZED))
        return F.array_union(F.array_union(F.array_intersect(low(raw), listed(_RISKY)), low(inside)), capitals)

    def left(x: Column) -> Column:
        return F.array_except(x["rest"], inflected(F.array_intersect(all_forms(x["rest"]), x["known"])))

    known = let(low(every(source, word, 0)), all_forms)
    lacking = let(F.struct(let(every(output, word, 0), sought).alias("sought"), known.alias("known")), lambda x: F.struct(F.array_except(x["sought"], x["known"]).alias("rest"), x["known"].alias("known")))
    none = F.array().cast("array<string>")
    return F.when(source.isNull() & output.isNotNull(), none).otherwise(F.slice(F.array_sort(let(lacking, left)), 1, cap))


_CAVEAT, _DETAIL, _REFERS, _CONDITION = (re.compile(p, re.I | re.A) for p in (CAVEAT, DETAIL, REFERENTIAL, CONDITIONAL))


def _utf16(text: str) -> int:
    """The length in UTF-16 units, in which budgets are stated."""
    return len(text) + sum(c > "\uffff" for c in text)


def _folded_words(text: str) -> list[str]:
    return re.findall(r"[^\W_][\w.-]+", unicodedata.normalize("NFKC", text).lower())


def _stands_alone(text: str) -> bool:
    """Whether a block names its subject itself: it has a detail, two sentences or more, and refers to nothing before it."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if s]
    return not _REFERS.match(text) and bool(_DETAIL.search(text)) and len(sentences) >= 2


def _units(kept: list[str]) -> list[tuple[int, int, bool]]:
    """(first, last, caveat) runs of blocks that must be taken together: a caveat with the neighbours that it is about."""
    caveat, detail, refers = ([bool(p(t)) for t in kept] for p in (_CAVEAT.search, _DETAIL.search, _REFERS.match))
    runs: list[list[int]] = []
    for i, text in enumerate(kept):
        if not (caveat[i] or (detail[i] and _CONDITION.search(text))):
            continue
        leans = not _stands_alone(text)
        before = i > 0 and leans and (refers[i] or detail[i - 1] or caveat[i - 1])
        after = i + 1 < len(kept) and (refers[i + 1] or (leans and (detail[i + 1] or caveat[i + 1])))
        if runs and i - before <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], i + after)
        else:
            runs.append([i - before, i + after])
    held = {i for first, last in runs for i in range(first, last + 1)}
    return sorted([*((a, b, True) for a, b in runs), *((i, i, False) for i in range(len(kept)) if i not in held)])


def select_passages(
    blocks: list[str], title: str, chars: int = PASSAGE_CHARS, passages: int = PASSAGES, least: int = 20, most: tuple[int, int] | None = (PAGE_CHARS, PAGE_BLOCKS)
) -> list[str]:
    """Whole blocks, in order, within a budget: caveats together with the blocks they need first, then those near the title.

    Blocks equal in folded compatibility form count once. A unit that does not fit is skipped whole, and smaller ones after it
    are tried. A page of more characters or blocks than `most` gives none; with None for it, pages of any size are read.
    """
    if most is not None and (len(blocks) > most[1] or sum(map(_utf16, blocks)) > most[0]):
        return []
    first: dict[str, str] = {}
    for text in (" ".join(b.split()) for b in blocks):
        if _utf16(text) >= least:
            first.setdefault(unicodedata.normalize("NFKC", text).lower(), text)
    kept = list(first.values())
    if len(kept) <= passages and _utf16("\n".join(kept)) <= chars:
        return kept
    terms = set([w for w in _folded_words(title[:TITLE_CHARS]) if w not in PASSAGE_STOP_WORDS][:TITLE_TERMS])
    ranked = []
    for a, b, caveat in _units(kept):
        text = "\n".join(kept[a : b + 1])
        near = min(36, 6 * len(terms.intersection(_folded_words(text))))
        worth = 100 * caveat + near + 18 * bool(_DETAIL.search(text)) + {0: 24, 1: 10}.get(a, 0)
        ranked.append((-worth, a, b, _utf16(text)))
    chosen: list[int] = []
    used = 0
    for _, a, b, size in sorted(ranked):
        size += 1 if chosen else 0
        if used + size <= chars and len(chosen) + b - a + 1 <= passages:
            chosen += range(a, b + 1)
            used += size
    return [kept[i] for i in sorted(chosen)]


def passages(blocks: Column, title: Column, chars: int = PASSAGE_CHARS, count: int = PASSAGES) -> Column:
    """T19 as a column, for texts of any size: an Arrow-batched UDF, since greedy packing that skips is no expression."""

    @F.pandas_udf("array<string>")
    def run(b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([select_passages([x for x in (v if v is not None else []) if x], u or "", chars, count, most=None) for v, u in zip(b, t, strict=True)])

    return run(blocks, title)


def safe_excerpt(text: Column, words: int = 12, chars: int = 160) -> Column:
    """The first sentence that is short, declarative, free of links and quotation marks, without its final stop; else null."""
    segments = F.filter(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda s: s != "")
    fine = lambda s: (
        (F.regexp_count(s, F.lit(r"[\p{L}\p{N}]+")).between(1, words)) & (F.length(s) <= chars) & ~s.rlike(r"(?i)https?://|www\.")
        & ~s.rlike("[\"“”«»]") & ~s.rlike(r"[?:;…]\s*$") & ~s.rlike(r"(?i)^(?:ignore|click|subscribe|you must|please|do not)\b")
    )
    return F.regexp_replace(F.get(F.filter(segments, fine), F.lit(0)), r"[.!]+\s*$", "")


def version_bounds(text: Column) -> Column:
    """The sorted set of relation:version that text states; a longer wording hides the shorter one in it."""
    version = r"v?(\d{1,6}(?:\.\d{1,6}){1,3})(?![\p{L}\p{N}_+-]|\.\d)"
    said = lambda x, pattern, relation: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda v: F.concat(F.lit(f"{relation}:"), v))
    rest, out = text, []
    for relation, words in BOUNDS_BEFORE.items():
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_<>=])(?:{words})\s*(?:versions?\s+)?{version}"
        out.append(said(rest, pattern, relation))
        rest = F.regexp_replace(rest, pattern, " ")
    for relation, words in BOUNDS_AFTER.items():
        out.append(said(rest, rf"(?i)(?<![\p{{L}}\p{{N}}._+-]){version}\s+(?:{words})\b", relation))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*out))))


def bound_drift(claim: Column, source: Column) -> Column:
    """Bounds of claim for which source names the same version and direction with the end point treated otherwise."""
    other = lambda b: F.when(b.startswith("lte:"), F.regexp_replace(b, "^lte", "lt")).when(b.startswith("lt:"), F.regexp_replace(b, "^lt", "lte")).when(b.startswith("gte:"), F.regexp_replace(b, "^gte", "gt")).otherwise(F.regexp_replace(b, "^gt", "gte"))
    theirs = version_bounds(source)
    return F.filter(version_bounds(claim), lambda b: ~F.array_contains(theirs, b) & F.array_contains(theirs, other(b)))


def advisory_ranges(text: Column) -> Column:
    """Rows of the grammar 'product <version (CVE, CVE)' as (product, below, cves); null if a line with a CVE breaks it."""
    grammar = r"^(.{1,120}?) <(\d+(?:\.\d+)+) \((CVE-\d{4}-\d+(?:, CVE-\d{4}-\d+)*)\)$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"CVE-\d"))
    rows = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, grammar, 1).alias("product"), F.regexp_extract(x, grammar, 2).alias("below"), F.split(F.regexp_extract(x, grammar, 3), ", ").alias("cves")))
    return F.when(F.forall(lines, lambda x: x.rlike(grammar)), rows)


def apply_edit(text: Column, find: Column, put: Column, share: float = 0.25) -> Column:
    """Text with one phrase replaced; null unless it occurs once, as whole words, and is at most a share of the words."""
    words = lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+"))
    once = (F.length(text) - F.length(F.replace(text, find, F.lit("")))) == F.length(find)
    at = F.position(find, text)
    before, after = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + F.length(find), F.lit(1))
    edge = lambda c: ~c.rlike(r"[\p{L}\p{M}\p{N}_'’-]")
    whole = ((at == 1) | edge(before)) & edge(after)
    few = words(find) <= F.least(F.lit(8), F.floor(words(text) * share))
    return F.when((F.length(find) > 0) & once & whole & few & (find != put), F.replace(text, find, put))
