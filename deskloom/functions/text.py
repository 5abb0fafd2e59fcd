"""String functions as Column expressions. Nulls give nulls unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.functions import values as V

#: White space as in scripts of the web: ASCII's, no-break, and the Unicode separators.
SPACE = r"[\s   -     　﻿]"
_NO_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_edges(pattern: str) -> str:
    r"""pattern with \b as a boundary of ASCII words, whatever the JVM takes for a word character, and without case."""
    return "(?i)" + pattern.replace(r"\b", _EDGE)


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs in text."""
    return text.rlike("|".join(f"(?:{ascii_edges(p)})" for p in patterns))


def clean_text(text: Column, limit: int | None = 1200) -> Column:
    """CDATA, character references, scripts, tags and control characters resolved, white space collapsed, cut to limit (None: whole).

    Numeric references are decoded piece by piece: the text is split at them, and each piece's code point becomes a character.
    Texts without the character that a step's patterns begin with pass it by.
    """

    def references(x: Column) -> Column:
        x = _decoded(_decoded(x, r"&#(\d{1,8});", 10), r"(?i)&#x([0-9a-f]{1,7});", 16)
        for pattern, put in ((r"(?i)&(?:nbsp|#160);", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&apos;", "'")):
            x = F.regexp_replace(x, pattern, put)
        return x

    def tags(x: Column) -> Column:
        for tag in ("script", "style"):
            x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
        return F.regexp_replace(x, r"<[^>]+>", " ")

    x = text if limit is None else F.substring(text, 1, max(4096, min(100_000, 8 * limit)))
    for mark, step in (("<", lambda t: F.regexp_replace(t, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")), ("&", references), ("<", tags)):
        x = let(x, lambda t: F.when(t.contains(mark), step(t)).otherwise(t))
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    x = F.regexp_replace(single_spaces(x), "^ | $", "")
    return x if limit is None else F.substring(x, 1, limit)


def _decoded(text: Column, pattern: str, base: int) -> Column:
    """text with numeric character references replaced by their characters, other code points by nothing."""

    def character(code: Column) -> Column:
        n = F.conv(code, base, 10).cast("long")
        plain = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(plain, wide).otherwise(F.lit(""))

    def joined(t: Column) -> Column:
        codes, pieces = F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.split(t, pattern)
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(codes, rest, lambda c, p: F.concat(character(c), p)), ""))

    return let(text, lambda t: F.when(t.rlike(pattern), joined(t)).otherwise(t))


def plain_text(html: Column) -> Column:
    """An article fragment as text: tags to spaces, named references, control and format characters to spaces."""
    x = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    for name, put in (("nbsp", " "), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("amp", "&")):
        x = F.regexp_replace(x, rf"(?i)&{name};", put)
    x = F.regexp_replace(x, r"[\p{Cc}\p{Cf}]", " ")
    return F.regexp_replace(F.regexp_replace(x, SPACE + "+", " "), "^ | $", "")


def fold_dashes(text: Column) -> Column:
    """T03, the dashes: hyphens and dashes of Unicode as '-'."""
    return F.regexp_replace(text, r"[‐-―−]", "-")


@F.pandas_udf(T.StringType())
def _nfkc(texts):
    import unicodedata

    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


#: Characters that are their own compatibility form, whatever stands beside them: ASCII, most of Latin-1, common quotation marks.
_STABLE = r"[^\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF–—‘’‚‛“”„‟•‹›€]"


def nfkc(text: Column) -> Column:
    """Compatibility form with folded dashes. Spark has no NFKC, so this one is an Arrow-batched UDF, for texts that need it."""
    odd = (F.length(text) != F.octet_length(text)) & text.rlike(_STABLE)
    return fold_dashes(F.coalesce(_nfkc(F.when(odd, text)), text))


def single_spaces(text: Column) -> Column:
    """text with each run of white space as one blank; lone blanks, which most are, are left as they stand."""
    return F.regexp_replace(text, f"(?! {_NO_SPACE}){SPACE}+", " ")


def tokens(text: Column, stop_words: list[str] | None = None, once: bool = False) -> Column:
    """Lower-case tokens of letters, digits and hyphens, longer than one character, without stop words; with `once` each
    once, which spares the words that a long text repeats."""
    plain = fold_dashes(text)
    node = F.regexp_replace(plain, r"(?i)(?<![A-Za-z0-9_])node\.js(?![A-Za-z0-9_])", "nodejs")
    low = F.lower(F.when(F.lower(text).contains("node.js"), node).otherwise(plain))
    stop = F.array(*[F.lit(w) for w in (V.STOP_WORDS if stop_words is None else stop_words)]).cast("array<string>")
    words = F.split(F.regexp_replace(low, r"[^a-z0-9-]+", " "), " ")
    if once:
        return F.filter(F.array_except(words, stop), lambda t: F.length(t) > 1)
    return F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def stem(token: Column) -> Column:
    """Aliases, then -ies to -y, then a final -s that is no part of -ss, -us or -is."""
    alias = F.create_map(*[F.lit(x) for pair in V.ALIASES.items() for x in pair])
    plural = F.when((F.length(token) > 5) & token.endswith("ies"), F.concat(F.expr("''"), F.regexp_replace(token, "ies$", "y")))
    single = F.when((F.length(token) > 4) & token.endswith("s") & ~token.rlike("(?:ss|us|is)$"), F.regexp_replace(token, "s$", ""))
    return F.coalesce(F.element_at(alias, token), plural, single, token)


def title_tokens(title: Column, cap: int | None = None) -> Column:
    """T06, as the ledger takes them: the sorted set of stemmed title tokens without years. cap: the first few."""
    stemmed = F.transform(tokens(title, once=True), stem)
    kept = F.array_sort(F.array_distinct(F.filter(stemmed, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d{4}$"))))
    return kept if cap is None else F.slice(kept, 1, cap)


def event_tokens(title: Column) -> Column:
    """T06, as event matching takes them: without the words of the beat; hyphened tokens also give their parts."""
    generic = F.array(*[F.lit(w) for w in V.EVENT_STOP_WORDS])
    own = F.array_except(tokens(title, once=True), generic)
    split = lambda t: F.when(t.contains("-") & ~t.isin(V.WHOLE_TOKENS), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))
    parts = F.flatten(F.transform(F.transform(own, stem), split))
    return F.sort_array(F.filter(F.array_except(parts, generic), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d{4}$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_count(text: Column) -> Column:
    """Words of letters and digits, with inner apostrophes and hyphens."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sentence_count(text: Column) -> Column:
    """Runs between sentence ends that have a word; dots inside words end nothing."""
    masked = F.regexp_replace(text, r"(?<=[\p{L}\p{N}_-])\.(?=[\p{L}\p{N}_-])", "x")
    return F.size(F.filter(F.split(masked, r"[.!?…]+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))).cast("long")


def sentences(text: Column) -> Column:
    """Text split after sentence ends that white space follows."""
    return F.filter(F.split(text, r"(?<=[.!?…])\s+"), lambda s: F.length(s) > 0)


def shingles(words: Column, n: int) -> Column:
    """The runs of n words, joined by spaces; none for fewer words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.expr("cast(array() as array<string>)")))


def shares_run(a: Column, b: Column, n: int) -> Column:
    """Whether two lists of words share a run of n; runs are compared by hashes first."""
    hashes = lambda words: F.transform(words, lambda t: F.xxhash64(t))
    runs = lambda words: let(
        hashes(words),
        lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    return F.when(F.arrays_overlap(runs(a), runs(b)), F.arrays_overlap(shingles(a, n), shingles(b, n))).otherwise(F.lit(False))


def number_tokens(text: Column) -> Column:
    """The sorted set of tokens that hold a digit."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]*\d[a-z0-9]*(?:[.,]\d+)*"), F.lit(0))))


def unsupported_numbers(output: Column, source: Column, cap: int = 8) -> Column:
    """Tokens with digits in output that source lacks, the first few in order."""
    return F.slice(F.array_sort(F.array_except(number_tokens(output), number_tokens(source))), 1, cap)


def term_pattern(term: str, dialect: str = "java") -> str:
    """A term as a whole-word pattern; blanks, slashes and hyphens stand for each other."""
    import re

    body = r"[\s/-]+".join(re.escape(p) for p in re.split(r"[\s/-]+", term.lower()) if p)
    return f"(?:^|[^a-z0-9]){body}(?:$|[^a-z0-9])"


def forms(term: str) -> list[str]:
    return [term, *V.INFLECTIONS.get(term, [])]


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))


def _plain(form: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", form)


def _met(text: Column, words: Column, term: str, known: Column | None = None) -> Column:
    """A plain search in the text's words comes first; the pattern, which also minds what parts the words, follows only there.

    known: the words among the terms' first ones that the text has, which spare most of the searches.
    """
    near = F.lit(False)
    for form in forms(term):
        own = _plain(form)
        here = words.contains(f" {' '.join(own)} ")
        if known is not None:
            here = F.array_contains(known, own[0]) & here if own[1:] else F.array_contains(known, own[0])
        near = near | here
    return near & text.rlike("|".join(term_pattern(f) for f in forms(term)))


def has_term(text: Column, term: str) -> Column:
    """Whether lower-case text has the term or one of its inflections, which count once."""
    return _met(text, _words(text), term)


def term_hits(text: Column, terms: list[str]) -> Column:
    """For each of the terms whether lower-case text has it; the text's words are taken once for all."""
    first = F.array(*[F.lit(w) for w in sorted({_plain(f)[0] for term in terms for f in forms(term)})])
    words = let(F.struct(text.alias("t"), _words(text).alias("w")), lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"), F.array_intersect(F.split(x["w"], " "), first).alias("k")))
    return let(words, lambda x: F.array(*[_met(x["t"], x["w"], term, x["k"]) for term in terms]))


def weighted(hits: Column, weights: list[float]) -> Column:
    """The sum of the weights whose place in hits is true."""
    return F.aggregate(F.zip_with(hits, F.array(*[F.lit(float(w)) for w in weights]), lambda h, w: F.when(h, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, w: a + w)


def term_score(text: Column, terms: dict[str, int], factor: float = 1.0) -> Column:
    """The sum of weight * factor over the terms in text."""
    return weighted(term_hits(text, list(terms)), [w * factor for w in terms.values()])


def count_terms(text: Column, terms: list[str]) -> Column:
    """The number of the terms that text has; 0 for none or a null."""
    return F.size(F.filter(term_hits(text, terms), lambda h: h))


def identifiers(text: Column) -> Column:
    """The sorted set of vulnerability identifiers, in lower case."""
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:CVE-\d{4}-\d{4,}|GHSA-[a-z0-9-]{8,})(?![A-Za-z0-9_])"
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lower(x))))
    low = F.lower(text)
    return F.when(~low.contains("cve-") & ~low.contains("ghsa-"), F.array().cast("array<string>")).otherwise(found)


def canonical_url(url: Column, tracking: str = V.TRACKING, add_slash: bool = False) -> Column:
    """Https, no fragment, no tracking parameters, the query sorted. Null for what is no http(s) URL with a host."""

    def canonical(bare: Column) -> Column:
        path = F.regexp_extract(bare, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
        path = F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))
        if add_slash:
            path = let(path, lambda p: F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/"))))
        query = F.regexp_extract(bare, r"\?(.*)$", 1)
        kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike("(?i)" + tracking)))
        tail = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
        host = F.lower(F.regexp_extract(bare, r"(?i)^https?://([^/?#]+)", 1))
        return let(host, lambda h: F.when(h != "", F.concat(F.lit("https://"), h, path, tail)))

    return let(F.regexp_replace(F.trim(url), "#.*$", ""), canonical)


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """Https, no credentials, default port, a listed host, 2048 characters at most."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":443$", ""))
    return (authority != "") & ~authority.contains("@") & host.isin(hosts) & (F.length(url) <= 2048)


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def escape_html(text: Column) -> Column:
    """The five characters that markup needs escaped."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def safe_code(code: Column, known: list[str], other: str) -> Column:
    """The code if it is known, else other; null is other."""
    return F.when(code.isin(known), code).otherwise(F.lit(other))


def base64url(data: Column) -> Column:
    """base64 with the URL alphabet and no padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(data), r"[\r\n]", ""), "+/=", "-_ "))


def hmac_sha256(key: str | bytes, message: Column) -> Column:
    """HMAC-SHA-256 as lowercase hex; the key's two pads are literals, the hashing is Spark's."""
    import hashlib

    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "utf-8")), 256))), 256)


def by_locale(text: Column) -> Column:
    """Text as a key that sorts as words do in a dictionary (ICU's root order): letters before case and accents, both counted.

    Equal keys may be different texts, such as composed and decomposed forms, so a total order ends with the text itself.
    """
    return F.collate(text, "UNICODE")


#: The letters from À to ÿ: their base letters (÷ and × before, þ after all others) and their marks in the order of ICU's root collation.
_MARKED = "".join(map(chr, range(0xC0, 0x100)))
_BASE = "aaaaaaaceeeeiiiidnooooo\"ouuuuy{saaaaaaaceeeeiiiidnooooo!ouuuuy{y"
_MARK = "2136549821352135962136507213510921365498213521359621365072135105"
_AZ = "abcdefghijklmnopqrstuvwxyz"


def latin_key(word: Column) -> Column:
    """The order of ICU's root collation as plain strings, for words of A-Z, a-z and À-ÿ alone: base letters, marks, capitals.

    Equal keys are equal words. A lower-case word of a-z is its own key, as nothing with its letters stands before it.
    """
    low, plain = F.lower(word), F.length(word) == F.octet_length(word)
    capitals = lambda w: F.translate(w, _AZ + _AZ.upper() + _MARKED, "0" * 26 + "1" * 26 + "1" * 31 + "0" * 33)
    marks = lambda w: F.translate(w, _AZ + _AZ.upper() + _MARKED, "0" * 52 + _MARK)
    wide = F.replace(F.replace(F.replace(word, F.lit("æ"), F.lit("æe")), F.lit("Æ"), F.lit("ÆE")), F.lit("ß"), F.lit("ßs"))
    marked = let(wide, lambda w: F.concat(F.translate(w, _AZ.upper() + _MARKED, _AZ + _BASE), F.lit("\1"), marks(w), F.lit("\1"), capitals(w)))
    return F.when(plain & (low == word), word).when(plain, F.concat(low, F.lit("\1\1"), capitals(word))).otherwise(marked)


def sorted_latin(words: Column) -> Column:
    """An array of such words in the order of latin_key, which stands before the words that differ from it while they are sorted."""
    own = lambda w: (F.length(w) == F.octet_length(w)) & (F.lower(w) == w)
    keyed = F.transform(words, lambda w: F.when(own(w), w).otherwise(F.concat(latin_key(w), F.lit("\0"), w)))
    return F.transform(F.sort_array(keyed), lambda x: F.when(x.contains("\0"), F.substring_index(x, "\0", -1)).otherwise(x))
