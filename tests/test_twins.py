"""Queries that SQL can't express, row by row against plain Python on the smallest tables."""

import os
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from deskloom import plans
from deskloom.checkpoints import checkpointed
from deskloom.functions import prose
from deskloom.functions import values as V
from deskloom.operators import matching
from deskloom.plans import text_and_pages as T

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
WORD = regex.compile(r"[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, key, value):
    return {r[key]: r[value] for r in plans.QUERIES[name](spark, DATA).collect()}


def halves(text):
    half = len(text) // 2
    return text[:half], text[half:]


def test_nfkc(spark, documents):
    fold = lambda x: regex.sub("[‐-―−]", "-", x if x.isascii() else unicodedata.normalize("NFKC", x))
    assert rows(spark, "t03_nfkc", "doc_id", "text") == {k: fold(x) for k, x in documents.items()}


def forms(w):
    out = {w}
    if regex.search("['’]s$", w):
        out.add(w[:-2])
    if len(w) > 4 and w.endswith("ies"):
        out.add(w[:-3] + "y")
    if len(w) > 4 and w.endswith("s") and not w.endswith("ss"):
        out.add(w[:-1])
    if len(w) > 5 and w.endswith("ed"):
        out |= {w[:-2], w[:-1]}
    if len(w) > 6 and w.endswith("ing"):
        out |= {w[:-3], w[:-3] + "e"}
    return out


def names(output, source):
    known = {f for w in WORD.findall(source) for f in forms(w.lower())}
    found = set()
    for m in WORD.finditer(output):
        raw, before = m[0], output[: m.start()]
        low = raw.lower()
        first = not before or bool(regex.search(r"[.!?…]\s{0,40}$", before))
        capital = raw[0].isupper() and unicodedata.category(raw[0]) == "Lu" and not first and low not in prose.SAFE_CAPITALIZED
        if forms(low) & set(prose.HIGH_RISK_TERMS) or regex.search(r"\p{Ll}\p{Lu}|\p{Lu}{2}", raw) or capital:
            if not forms(low) & known:
                found.add(low)
    return sorted(found)[:8]


def test_names(spark, documents):
    got = rows(spark, "t12_unsupported_names", "doc_id", "names")
    want = {k: " ".join(names(*reversed(halves(x)))) for k, x in documents.items()}
    assert got == want and any(want.values())


def test_summary_checks(spark, documents):
    got = {}
    for r in plans.QUERIES["q10_summary_checks"](spark, DATA).collect():
        got.setdefault(r["doc_id"], set()).add(r["code"])
    numbers = lambda x: set(regex.findall(r"[a-z0-9]*[0-9][a-z0-9]*(?:[.,][0-9]+)*", x.lower()))
    runs = lambda x: {tuple(w[i : i + 12]) for w in [regex.findall(r"[\p{L}\p{N}]+", x.lower())] for i in range(len(w) - 11)}
    for k, text in documents.items():
        summary, source = halves(text)
        want = set()
        if not 40 <= len(WORD.findall(summary)) <= 220:
            want.add("WORD_RANGE")
        if numbers(summary) - numbers(source):
            want.add("UNSUPPORTED_NUMBERS")
        if names(summary, source):
            want.add("UNSUPPORTED_NAMES")
        if runs(summary) & runs(source):
            want.add("COPIED_RUN")
        assert got.get(k, set()) - {"PROSE"} == want, k


def every_pair(items):
    """All pairs that match, by the predicate alone."""
    a, b = items.alias("a"), items.alias("b")
    return {tuple(r) for r in a.crossJoin(b).where(F.col("a.item") < F.col("b.item")).where(matching.pair_predicate()).select("a.item", "b.item").collect()}


def test_headline_matches(spark):
    got = {tuple(r) for r in plans.QUERIES["c01_headline_matches"](spark, DATA).collect()}
    assert got == every_pair(checkpointed(T._headlines(spark, DATA))) and got


def test_complete_link_groups(spark):
    title, host = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1), F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1))
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", title.alias("title"), host.alias("host"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("page"))
    items = checkpointed(matching.features(pages, "page_id", "title", "host", "page"))
    pairs = every_pair(items)
    groups, own = [], {}
    for r in sorted(items.select("title", "url", "item").collect(), key=lambda r: (r["title"].encode(), r["url"].encode(), r["item"])):
        home = next((g for g in groups if all((min(m, r["item"]), max(m, r["item"])) in pairs for m in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(r["item"])
        own[r["item"]] = home[0]
    got = {r["item"]: r["group"] for r in plans.QUERIES["c06_complete_link_groups"](spark, DATA).collect()}
    same = lambda of: {frozenset(k for k, g in of.items() if g == x) for x in set(of.values())}
    assert same(got) == same(own)


def test_fixed_values_are_lists():
    assert len(V.STOP_WORDS) == len(set(V.STOP_WORDS)) and all(isinstance(v, list) for v in (V.STOP_WORDS, V.FAILURE_CODES, prose.SCHEMA_KEYS, *V.INFLECTIONS.values()))
