"""That expressions on long texts and large tables do their work once, and in bounded tasks; results are tested elsewhere too."""

import os
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from deskloom import plans
from deskloom.functions import events, prose, roles, text
from deskloom.operators import editorial, matching
from deskloom.plans import text_and_pages
from deskloom.sources import feeds
from tests.test_functions import ONE_EVENT, TWO_EVENTS

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_prose_is_prepared_once(spark):
    """Each pass of replacements over the text stood in every rule before."""
    assert str(prose.prose_codes(F.col("text"), True)).count("regexp_replace") <= 2
    marks = "\")] »'" * 500
    cases = {
        "Fine." + marks: "", "It ends and." + marks: "READER_PROSE_DANGLING_ENDING", "x" + marks: "READER_PROSE_INCOMPLETE", "Wait.." + marks: "READER_PROSE_INCOMPLETE",
        "A “b' c.": "READER_PROSE_UNBALANCED_QUOTE", "‘text’: 1.": "READER_PROSE_SCHEMA_FRAGMENT", "a (s1p2) b.": "READER_PROSE_INTERNAL_CITATION", "a\n ```.": "READER_PROSE_STRUCTURE", " ": "READER_PROSE_EMPTY",
        None: "READER_PROSE_TYPE",
    }
    rows = spark.createDataFrame([(t, c) for t, c in cases.items()], "text string, codes string")
    got = rows.select("text", "codes", F.array_join(prose.prose_codes(F.col("text"), True), ",").alias("found")).collect()
    assert [(r.text, r.found) for r in got] == [(r.text, r.codes) for r in got]


def test_names_by_set_operations(spark):
    """Each word sought was compared with all words of the source before, which took minutes here."""
    n = 30_000
    names = lambda end: F.array_join(F.transform(F.sequence(F.lit(100), F.lit(n)), lambda i: F.concat(F.lit("of N"), F.translate(i.cast("string"), "0123456789", "abcdefghij"), F.lit(end))), " ")
    rows = spark.range(1).select(names("ing").alias("output"), names("ed").alias("source"))
    start = time.perf_counter()
    assert rows.select(F.size(prose.unsupported_names(F.col("output"), F.col("source"), n)).alias("n")).first().n == 0
    other = rows.select(F.size(prose.unsupported_names(F.col("output"), F.lit("of nb"))).alias("n")).first().n
    assert other == 8 and time.perf_counter() - start < 30


def test_forms_are_those_of_columns(spark):
    words = ["attacks", "attacked", "firing", "purchases", "bodies", "bus's", "glass", "used", "zero-days", "vulnerabilities", "sueing", "ties", "king"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", prose.lexical_forms(F.array("w")).alias("f"), prose.all_forms(F.array("w")).alias("g")).collect()
    assert [set(r.f) for r in rows] == [set(prose._forms(r.w)) for r in rows] == [set(r.g) for r in rows]
    made = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.explode(prose.lexical_forms(F.array("w"))).alias("f")).where("w <> f").select("w", "f", prose.inflected(F.array("f")).alias("m")).collect()
    assert made and all(r.w in r.m for r in made)
    ends = spark.createDataFrame([(w,) for w in ("use", "body", "bus", "buy", "fire", "make", "attack", "of", "é")], "w string").select("w", F.explode(prose.inflected(F.array("w"))).alias("m")).collect()
    assert all(r.w in prose._forms(r.m) for r in ends)
    assert all((w in prose._RISKY) == bool(set(prose._forms(w)) & set(prose.HIGH_RISK_TERMS)) for w in words)


def test_shared_runs(spark):
    """Q10: runs meet by hashes, with the result of the runs themselves; a missing or short text shares none."""
    rows = spark.createDataFrame([("a b c d", "x b c d", True), ("a b c", "a b x c", False), ("a b", "a b", False), (None, "a b c", False)], "a string, b string, want boolean")
    got = rows.select("want", text.shares_run(F.split("a", " "), F.split("b", " "), 3).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("name", ["t15_product_tags", "c03_role_anchors", "c04_polarity_flags"])
def test_small_files_are_dealt_out(spark, name):
    """One file of parts was one task before, whatever its rows cost."""
    rows = plans.QUERIES[name](spark, DATA)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_drafts_are_written_by_several_tasks(spark, monkeypatch):
    """Q02: customers were made into drafts by the one task that reads them before."""
    seen = []
    issues = editorial.newsroom_issues
    monkeypatch.setattr(editorial, "newsroom_issues", lambda rows, **more: (seen.append(rows), issues(rows, **more))[1])
    plans.QUERIES["q02_newsroom_issues"](spark, DATA)
    assert len(seen[0].inputFiles()) > 1


def test_editions_are_read_once(spark):
    """Q01: documents were parsed for the edition, for its desks and for its stories before."""
    plan = plans.QUERIES["q01_edition_rules"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_clauses_leave_plain_texts_as_they_are(spark):
    """Texts that are their own compatibility form are not sent to Python, lone blanks are not replaced, with the same results."""
    texts = ["a b", " a  b\tc ", "a\u00a0\u2003 b", "\u3000", "x ", "  x", "é “a” – ß", "e\u0301 ﬁ ² …", "A\u2011b", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", text.nfkc(F.col("t")).alias("n"), text.single_spaces(F.col("t")).alias("s"), F.regexp_replace("t", text.SPACE + "+", " ").alias("want")).collect()
    fold = lambda x: re.sub("[‐-―−]", "-", unicodedata.normalize("NFKC", x))
    assert [r.s for r in got] == [r.want for r in got] and [r.n for r in got] == [r.t and fold(r.t) if r.t else r.t for r in got]
    stable = [chr(c) for c in range(0x2040) if not re.match(text._STABLE, chr(c))]
    assert len(stable) > 200 and all(unicodedata.normalize("NFKC", c) == c for c in stable)


def test_matches_hold_no_table_on_the_driver(spark, tmp_path):
    """Tables of classes and members were broadcast while they seemed small, several at once."""
    items = [(i, f"Google unveils big red part number{'abcdefg'[i % 7]} in steel", "p", f"https://x.example.com/{i // 2}") for i in range(28)]
    rows = spark.createDataFrame(items, "item long, title string, publisher string, url string")
    pairs = matching.matching_pairs(matching.checkpointed(matching.features(rows, "item", "title", "publisher", "url")))
    assert pairs.count() > 28 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_headlines_read_the_first_words_only(spark, tmp_path, monkeypatch):
    """All words of a whole text were taken before, for its first eight."""
    texts = ["... a, b-c", "", None, "one two three four five six seven eight nine ten", "!!", "Ünï 2 x"]
    rows = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    taken, features = [], matching.features
    monkeypatch.setattr(matching, "features", lambda rows, *more: (taken.append(rows), features(rows, *more))[1])
    text_and_pages._headlines(spark, str(tmp_path))
    assert "{0,8}" in taken[0]._jdf.queryExecution().analyzed().toString()
    titles = [r.title for r in taken[0].where("publisher = 'p'").orderBy("item").collect()]
    words = [" ".join(re.findall(r"[^\W_]+", t or "")[:8]) for t in texts]
    ends = [text_and_pages._ENDS[2 * (i % 8)] for i in range(len(texts))]
    assert titles == [f"Google {w} {e}" for w, e in zip(words, ends, strict=True)]


def test_feeds_are_parsed_once(spark):
    """Each body was parsed once for RSS and once for Atom, and items were cleaned before and after the filter on them."""
    plan = plans.QUERIES["s01_xml_feeds"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == plan.count("Relation") == 1
    assert plan.count(", 1, 16384)") == plan.count(", 1, 4096)") == 1  # the whole of a url and of a title, each cleaned once
    item, entry = "<item><title>a&#38;lt;b</title></item>", '<entry><title>e</title><link href="https://x.example.com/"/></entry>'
    bodies = [("both", f"<x><channel>{item * 3}</channel>{entry * 2}</x>"), ("none", "<rss/>"), ("null", None)]
    rows = feeds.parse_xml(spark.createDataFrame(bodies, "source_id string, body string"), cap=2)
    assert sorted((r.source_id, r.position, r.title, r.url) for r in rows.select("source_id", "position", "title", F.coalesce("url", F.lit("")).alias("url")).collect()) == [
        ("both", i, *x) for i in (0, 1) for x in (("a&lt;b", ""), ("e", "https://x.example.com/"))
    ]


def test_plain_searches_come_before_patterns():
    """A pattern's words stand in each of its matches, so titles without them need no pattern."""
    tables = [events.ACTIONS, events.ARTIFACTS, events.OBJECTS, events.LAST_OBJECTS, events.LIFECYCLE, events.FACETS, events.NAMED, events.FEATURES, events.COMPONENTS, events.VERSIONS]
    patterns = [p for table in tables for ps in table.values() for p in ps] + [p for _, p in events.STAGES] + [c.pattern for c in [*roles.LEGAL, *roles.INVESTIGATION, *roles.ACQUISITION]]
    assert all(events.needed(p) for p in patterns) and not events.needed(r"\b[a-z]+\d?\b") and events.needed(r"\bsu(?:ed|ing)|[$]?bid x?") == {"su", "bid "}
    titles = [t.lower() for pair in ONE_EVENT + TWO_EVENTS for t in pair]
    found = [(p, t) for p in patterns for t in titles if re.search(p, t)]
    assert found and all(any(w in t for w in events.needed(p)) for p, t in found)


def test_common_words_make_no_candidates(spark):
    """Titles of a publisher with a few common words, and ends that no event has both of, were compared by all their features."""
    rows = [(i, f"Google alder birch cedar {'launches app' if i % 2 else 'hires staff'} {w}{i} {w}{i + 99}", "p", f"u{i}") for i, w in enumerate(["yew"] * 60)]
    rows += [(100 + i, f"Google unveils blue round wheel maker {end}", "p", f"w{i}") for i, end in enumerate(("app", "extension", "lawsuit filed", "Android"))]
    items = matching.features_by_title(spark.createDataFrame(rows, "i int, t string, p string, u string"), "i", "t", "p", "u").persist()
    a, b = items.alias("a"), items.alias("b")
    every = {tuple(r) for r in a.crossJoin(b).where(F.col("a.item") < F.col("b.item")).where(matching.pair_predicate()).select("a.item", "b.item").collect()}
    pairs = {tuple(r) for r in matching.block_pairs(matching._blocks(items)).collect()}
    assert every <= pairs and len(pairs) < 500  # of 870 that share two of their rarer words and the end
