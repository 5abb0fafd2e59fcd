"""One fixture for each way to fail, written by hand."""

from deskloom.operators import binding

EVIDENCE = "candidate int, record int, source_id string, title string, publisher string, published_at string, text string, bound string"
SOURCES = "candidate int, id string, title string, publisher string, published_at string, relationship string"


def test_bind_evidence(spark):
    sources = [(1, "a", "T", "P", "d", "originating"), (1, "b", "T", "P", None, "independent"), (1, "c", "T", "P", "d", "context"), (1, "t", "T", "P", "d", "independent"), (1, "t", "T", "P", "d", "independent"),
               (2, "a", "T", "P", "d", "aggregator"), (2, "n", None, None, None, "independent"), (2, None, "T", "P", "d", "independent"), (2, "x", "T", "P", None, None), (3, "a", "T", "P", "d", "originating"), (4, "a", "T", "P", "d", "originating"),
               *[(5, f"s{i}", "T", "P", "d", "independent") for i in range(9)]]
    evidence = [(1, 1, "a", "T", "P", "d"), (1, 2, "b", "T", "P", "other"), (1, 3, "c", "T", "P", "d"), (1, 4, "t", "T", "P", "d"), (2, 1, "a", "T", "P", "d"), (2, 2, "n", None, None, None), (2, 3, None, "T", "P", "d"), (2, 4, "x", "T", "P", None),
                *[(3, i, "a", "T", "P", "d") for i in range(5)], (4, 1, "a", "U", "P", "d"), (4, 2, "a", "T", "Q", "d"), (4, 3, "a", "T", "P", "e"), (4, 4, "a", "T", "P", "d"), (5, 1, "s1", "T", "P", "d"), (6, 1, "a", "T", "P", "d")]
    rows = spark.createDataFrame([(*e, "text", "clash") for e in evidence], EVIDENCE)
    got = {(r["candidate"], r["record"]): r["code"] for r in binding.bind_evidence(rows, spark.createDataFrame(sources, SOURCES)).collect()}
    want = {(1, 1): None, (1, 2): None, (1, 3): "SOURCE_UNKNOWN", (1, 4): "SOURCE_TWICE", (2, 1): "RELATIONSHIP_INVALID", (2, 2): None, (2, 3): "SOURCE_UNKNOWN", (2, 4): "RELATIONSHIP_INVALID",
            **{(3, i): "EVIDENCE_BOUNDS" for i in range(5)}, (4, 1): "TITLE_DIFFERS", (4, 2): "PUBLISHER_DIFFERS", (4, 3): "DATE_DIFFERS", (4, 4): "RECORDS_CONFLICT", (5, 1): "EVIDENCE_BOUNDS", (6, 1): "SOURCE_UNKNOWN"}
    assert got == want
    assert binding.bind_evidence(rows.limit(0), spark.createDataFrame(sources, SOURCES)).count() == 0
    assert {r["code"] for r in binding.bind_evidence(rows.where("candidate = 1"), spark.createDataFrame([], SOURCES)).collect()} == {"SOURCE_UNKNOWN"}


def worlds(spark, cases):
    """Editions with a corroborated event `e` and a single one `s`, each with its story; changes replace an edition's tables."""
    article = lambda e, i, key, rel, url=None: ("E", e, i, "T", key.upper(), key, url or f"u{i}", rel, "d")
    tables = {
        "stories": [("E", "1", 1, "e", "Desk"), ("E", "2", 2, "s", "Desk")],
        "candidates": [("E", "e", "Desk", 2, 2, ["p", "q"], True, None), ("E", "s", "Desk", 1, 1, ["p"], False, "authoritative-single")],
        "sources": [article("e", "a", "p", "originating"), article("e", "b", "q", "independent"), article("e", "c", "p", "context"), article("s", "a", "p", "originating"), article("s", "c", "p", "context"), article("s", "d", "q", "context")],
        "chosen": [("E", s, i, "T", p, f"u{i}", rel, "d") for s, i, p, rel in [("1", "a", "P", "originating"), ("1", "b", "Q", "independent"), ("2", "a", "P", "originating"), ("2", "c", "P", "context")]],
        "required": [("E", "e"), ("E", "s")],
    }
    kinds = {
        "stories": "edition string, story string, position int, event_key string, desk string",
        "candidates": "edition string, event_key string, desk string, item_sources int, publishers int, publisher_keys array<string>, corroborated boolean, tier string",
        "sources": "edition string, event_key string, id string, title string, publisher string, publisher_key string, url string, relationship string, published_at string",
        "chosen": "edition string, story string, id string, title string, publisher string, url string, relationship string, published_at string",
        "required": "edition string, event_key string",
    }
    rows = {name: [(f"{i}", *r[1:]) for i, changes in enumerate(cases) for r in changes.get(name, list)(tables[name])] for name in tables}
    dfs = {name: spark.createDataFrame(rows[name], kinds[name]) for name in tables}
    got = binding.closed_world(dfs["stories"], dfs["candidates"], dfs["sources"], dfs["chosen"], dfs["required"], singles=True).collect()
    return [sorted((r["scope"], r["key"], r["code"]) for r in got if r["edition"] == f"{i}") for i in range(len(cases))]


def swap(i, row):
    return lambda rows: [*rows[:i], row, *rows[i + 1 :]]


def add(*more):
    return lambda rows: [*rows, *more]


def test_closed_world(spark):
    cases = [
        ({}, []),
        (dict(stories=swap(0, ("E", "1", 1, "?", "Desk"))), [("event", "e", "REQUIRED_UNUSED"), ("story", "1", "EVENT_UNKNOWN")]),
        (dict(stories=swap(1, ("E", "2", 2, "e", "Desk"))), [("event", "s", "REQUIRED_UNUSED"), ("story", "2", "EVENT_REUSED")]),
        (dict(stories=swap(0, ("E", "1", 1, "e", None))), [("story", "1", "DESK_WRONG")]),
        (dict(sources=add(("E", "e", "a", "T", "P", "p", "ua", "originating", "d"))), [("story", "1", "DOSSIER_SOURCE_REPEATED")]),
        (dict(candidates=swap(0, ("E", "e", "Desk", 3, 2, ["p", "q"], True, None))), [("story", "1", "EVENT_UNCORROBORATED")]),
        (dict(candidates=swap(0, ("E", "e", "Desk", 2, 2, ["p", "x"], True, None))), [("story", "1", "EVENT_UNCORROBORATED")]),
        (dict(candidates=swap(1, ("E", "s", "Desk", 1, 1, ["p"], False, "corroborated"))), [("story", "2", "EVENT_UNCORROBORATED")]),
        (dict(sources=swap(4, ("E", "s", "c", "T", "P", "p", "ua", "context", "d"))), [("story", "2", "EVENT_UNCORROBORATED")]),
        (dict(chosen=lambda rows: rows[1:]), [("story", "1", "SOURCES_TOO_FEW")]),
        (dict(chosen=swap(0, ("E", "1", "a", "T", "P", "ua", "originating", None))), [("story", "1", "SOURCE_CHANGED")]),
        (dict(chosen=swap(0, ("E", "1", "z", "T", "P", "ua", "originating", "d"))), [("story", "1", "SOURCE_CHANGED")]),
        (dict(chosen=add(("E", "1", "a", "T", "P", "ua", "originating", "d"))), [("story", "1", "SOURCE_REPEATED")]),
        (dict(chosen=swap(1, ("E", "1", "c", "T", "P", "uc", "context", "d"))), [("story", "1", "CORROBORATION_LACKING")]),
        (dict(chosen=swap(3, ("E", "2", "d", "T", "Q", "ud", "context", "d"))), [("story", "2", "AUTHORITATIVE_LIMITS")]),
        (dict(candidates=add(("E", "s", "Desk", 1, 1, ["p"], False, "authoritative-single"))), [("candidate", "s", "DOSSIER_REPEATED")]),
        (dict(required=add(("E", "e"))), [("event", "e", "REQUIRED_REPEATED")]),
        (dict(required=add(("E", "?"))), [("event", "?", "REQUIRED_UNKNOWN")]),
        (dict(required=lambda rows: rows[:1]), [("event", "s", "NOT_REQUIRED")]),
        (dict(required=lambda rows: []), []),
        (dict(stories=lambda rows: []), [("event", "e", "REQUIRED_UNUSED"), ("event", "s", "REQUIRED_UNUSED")]),
    ]
    assert worlds(spark, [changes for changes, _ in cases]) == [want for _, want in cases]
    assert worlds(spark, []) == []


def test_counts_shuffle_no_copies_of_rows(spark):
    """Several distinct counts beside each other would multiply each row before the shuffle."""
    schema = "edition int, event_key int, id string, title string, publisher string, publisher_key string, url string, relationship string, published_at date"
    sources = spark.createDataFrame([(1, 1, "a", "t", "p", "k", "u", "originating", None), (1, 1, "a", "t", "p", None, "v", "context", None)], schema)
    rows = binding._counts(sources, ["edition", "event_key"])
    assert "Expand" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.first().asDict()
    assert {k: got[k] for k in ("rows", "ids", "articles", "origins", "urls", "keys", "article_url", "alone")} == {"rows": 2, "ids": 1, "articles": 1, "origins": 1, "urls": 1, "keys": ["k"], "article_url": "u", "alone": "k"}


def test_sources_are_dealt_out_once(spark):
    """Q09: rows of sources and of stories' sources were shuffled for each rule; the result on them reads gathered candidates."""
    cols = "edition int, event_key int, id int, title string, publisher string, publisher_key string, url int, relationship string, published_at string"
    sources = spark.createDataFrame([(1, 1, i, "T", "P", k, i, r, "d") for i, k, r in [(1, "p", "originating"), (2, "q", "independent")]], cols)
    chosen = sources.drop("publisher_key").withColumnRenamed("event_key", "story")
    stories = spark.createDataFrame([(1, 1, 1, 1, "D"), (1, 2, 2, 1, "D")], "edition int, story int, position int, event_key int, desk string")
    candidates = spark.createDataFrame([(1, 1, "D", 2, 2, ["p", "q"], True, None)], "edition int, event_key int, desk string, item_sources int, publishers int, publisher_keys array<string>, corroborated boolean, tier string")
    out = binding.closed_world(stories, candidates, sources, chosen)
    assert [tuple(r) for r in out.collect()] == [(1, "story", "2", "EVENT_REUSED")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(id") == 1
    # a story that is told twice counts its sources twice
    twice = binding.closed_world(stories.where("story = 1").union(stories.where("story = 1")), candidates, sources, chosen)
    assert {r["code"] for r in twice.collect()} == {"SOURCE_REPEATED"}
