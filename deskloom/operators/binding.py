"""Closed-world binding (J07, Q09): what is written may only point to what was supplied, exactly once and unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.checkpoints import checkpointed
from deskloom.functions.text import let

# Relationships of a source that reports an event itself, and the most records and sources of a candidate.
REPORTING = ["originating", "independent"]
MOST_EVIDENCE, MOST_SOURCES = 4, 8

_STATED = ["title", "publisher", "url", "relationship", "published_at"]


def _first(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that holds; null if none does. A rule of unknown value doesn't hold."""
    code = F.when(F.lit(False), F.lit(""))
    for name, rule in rules:
        code = code.when(F.coalesce(rule, F.lit(False)), name)
    return code


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def bind_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Each record of evidence with the number of sources that it names and what keeps it from being bound.

    evidence has candidate, record (a key), source_id, title, publisher, published_at and text; sources has candidate, id, title,
    publisher, published_at and relationship. A record must name exactly one source that is no context, with its title and
    publisher; dates must be equal where both are known; records of one source must be equal. Nulls equal nulls. Counts come
    before the join, so each record meets at most one row; a repeated row is one more. Empty tables give no rows. Other columns
    are not looked at.
    """
    reports = F.col("relationship").isNull() | (F.col("relationship") != "context")
    row = F.struct(F.col("title").alias("s_title"), F.col("publisher").alias("s_publisher"), F.col("published_at").alias("s_published_at"), F.col("relationship").alias("s_relationship"))
    named = sources.where(reports).groupBy("candidate", F.col("id").alias("source_id")).agg(F.count("*").alias("bound"), F.min(row).alias("s"))
    held = sources.groupBy("candidate").agg(F.count("*").alias("held"))
    digest = F.sha2(F.to_json(F.struct("title", "publisher", F.col("published_at").cast("string").alias("published_at"), "text")), 256)
    known = evidence.select("candidate", "record", "source_id", "title", "publisher", "published_at", digest.alias("digest"))
    told = known.groupBy("candidate", "source_id").agg((F.min("digest") != F.max("digest")).alias("differ"))
    records = known.groupBy("candidate").agg(F.count("*").alias("records"))
    rows = known.join(named, ["candidate", "source_id"], "left").join(told, ["candidate", "source_id"], "left")
    rows = rows.join(records.join(held, "candidate", "left"), "candidate", "left").select("*", "s.*").withColumn("bound", F.coalesce("bound", F.lit(0)))
    code = _first(
        ("EVIDENCE_BOUNDS", (F.col("records") > MOST_EVIDENCE) | (F.col("held") > MOST_SOURCES)),
        ("SOURCE_UNKNOWN", F.col("bound") == 0), ("SOURCE_TWICE", F.col("bound") > 1),
        ("TITLE_DIFFERS", ~_same("title", "s_title")), ("PUBLISHER_DIFFERS", ~_same("publisher", "s_publisher")),
        ("RELATIONSHIP_INVALID", ~F.coalesce(F.col("s_relationship").isin(REPORTING), F.lit(False))),
        ("DATE_DIFFERS", F.col("published_at") != F.col("s_published_at")), ("RECORDS_CONFLICT", F.col("differ")),
    )
    return rows.select("candidate", "record", "bound", code.alias("code"))


def gathered(rows: DataFrame, key: list[str], name: str, *more: str) -> DataFrame:
    """Sources as one array per key, with _STATED, id and `more` as fields."""
    return rows.groupBy(*key).agg(F.collect_list(F.struct("id", *more, *_STATED)).alias(name))


def _article(x: Column) -> Column:
    return x["relationship"].isNull() | (x["relationship"] != "context")


def distinct(rows: str, column: str, where=_article) -> Column:
    """The distinct values that are not null of the sources in an array for which a condition holds; None: of all."""
    kept = F.col(rows) if where is None else F.filter(rows, where)
    return F.array_distinct(F.array_compact(F.transform(kept, lambda x: x[column])))


def _counts(sources: DataFrame, key: list[str]) -> DataFrame:
    """Per key: what its sources, rows or an array `held`, amount to, recomputed from them."""
    if "held" not in sources.columns:
        sources = gathered(sources, key, "held", "publisher_key")
    n = lambda where: F.size(F.filter("held", where)).cast("long")
    rows = sources.where(F.size("held") > 0).select(
        *key, F.size("held").cast("long").alias("rows"), F.size(distinct("held", "id", None)).alias("ids"), n(_article).alias("articles"), n(lambda x: x["relationship"] == "originating").alias("origins"),
        F.size(distinct("held", "url")).alias("urls"), F.sort_array(distinct("held", "publisher_key")).alias("keys"), F.array_max(distinct("held", "url")).alias("article_url"), "held",
    )
    return rows.withColumn("alone", F.when(F.size("keys") == 1, F.get("keys", F.lit(0))))


def _contexts(url: Column, held: Column, alone: Column) -> Column:
    """Of sources held in an array: those of context by the one publisher of the articles, and of a url unless that is None."""
    of = lambda x: (x["relationship"] == "context") & (x["publisher_key"] == alone)
    return F.filter(held, of if url is None else lambda x: of(x) & (x["url"] == url))


def _judged(picks: Column, held: Column, alone: Column) -> Column:
    """A story's sources as an array, each with what the candidate's array holds: its publisher's key, whether it differs, and whether it is such a context."""

    def judged(p: Column) -> Column:
        theirs = F.array_min(F.transform(F.filter(held, lambda x: x["id"] == p["id"]), lambda x: F.struct(x["publisher_key"].alias("publisher_key"), *[x[c].alias(c) for c in _STATED])))

        def row(x: Column) -> Column:
            same = x.isNotNull()
            for c in _STATED:
                same &= p[c].eqNullSafe(x[c])
            context = F.size(_contexts(p["url"], held, alone)) > 0
            return F.struct(p["id"].alias("id"), p["url"].alias("url"), p["relationship"].alias("relationship"), x["publisher_key"].alias("publisher_key"), (~same).alias("changed"), context.alias("of_publisher"))

        return let(theirs, row)

    return F.transform(picks, judged)


def closed_world(stories: DataFrame, candidates: DataFrame, sources: DataFrame, chosen: DataFrame, required: DataFrame | None = None, singles: bool = False) -> DataFrame:
    """Q09: (edition, scope, key, code): the first rule that each story, candidate or required event of an edition breaks.

    stories has edition, story, position, event_key and desk; candidates has edition, event_key, desk, item_sources, publishers,
    publisher_keys, corroborated and tier; sources has edition, event_key, id, title, publisher, publisher_key, url, relationship
    and published_at; chosen, a story's sources, has edition, story, id and the same columns but publisher_key; required has
    edition and event_key.

    A story binds one candidate, on its desk, which no story before it in the edition took. The candidate's counts of urls and
    publishers are taken again from its sources and must equal the ranked ones; it needs two publishers, or, with `singles`, one
    originating article with a context of its publisher. The story's sources must be the candidate's, unchanged, each once, of
    two urls, and by themselves amount to that evidence. Required events must be known, named once, and all events that stories
    take, no others. Every rule is an aggregate or a join on (edition, event) or (edition, story, source); no edition meets in one task, except that
    positions of stories that share an event are compared by their minimum. A candidate's sources are gathered as one array, and a story's
    as another, so that a row of them is dealt out once and not for each rule. Empty tables break no rule but REQUIRED_UNUSED.
    """
    event, story = ["edition", "event_key"], ["edition", "story"]
    picked = gathered(chosen, story, "picks").join(stories.select("edition", "story", "event_key"), story)
    return closed_world_of(stories, candidates, checkpointed(gathered(sources, event, "held", "publisher_key")), picked, required, singles)


def closed_world_of(stories: DataFrame, candidates: DataFrame, held: DataFrame, picked: DataFrame, required: DataFrame | None = None, singles: bool = False) -> DataFrame:
    """closed_world() of sources that were gathered before: held has edition, event_key and held, once each; picked has edition, story,
    event_key and picks for each row of stories with sources of its own."""
    event, story = ["edition", "event_key"], ["edition", "story"]
    supply = candidates.groupBy(*event).agg(
        F.count("*").alias("dossiers"),
        F.min(F.struct(F.col("desk").alias("c_desk"), "item_sources", "publishers", F.array_sort(F.array_distinct("publisher_keys")).alias("ranked"), "corroborated", "tier")).alias("c"),
    ).select(*event, "dossiers", "c.*")
    pages = F.array_distinct(F.transform(_contexts(None, F.col("held"), F.col("alone")), lambda x: x["url"]))
    totals = _counts(held, event).withColumn("pages", pages)
    totals = totals.withColumns({"contexts": F.size("pages"), "circular": F.array_max(F.transform("pages", lambda url: (url == F.col("article_url")).cast("int")))})
    consistent = (F.col("item_sources") == F.col("urls")) & (F.col("publishers") == F.size("keys")) & (F.col("ranked") == F.col("keys"))
    corroborated = F.col("corroborated") & (F.col("urls") >= 2) & (F.size("keys") >= 2) & consistent & F.coalesce(F.col("tier") == "corroborated", F.lit(True))
    single = F.lit(singles) & (F.col("tier") == "authoritative-single") & ~F.col("corroborated") & (F.col("articles") == 1) & (F.col("origins") == 1) & (F.size("keys") == 1)
    single &= F.coalesce(F.col("contexts") >= 1, F.lit(False)) & F.coalesce(F.col("circular") == 0, F.lit(False)) & consistent
    judged = supply.join(totals.drop("held", "pages"), event, "left").select(
        *event, "dossiers", "c_desk", (F.col("rows") > F.col("ids")).alias("ids_repeat"),
        F.coalesce(corroborated, F.lit(False)).alias("is_corroborated"), F.coalesce(single, F.lit(False)).alias("is_single"),
    )

    earliest = stories.groupBy(*event).agg(F.min("position").alias("taken"))
    told = stories.select("edition", "story", "position", "event_key", "desk").join(earliest, event, "left").join(judged, event, "left")

    picked = picked.join(held.select(*event, "held", F.when(F.size(distinct("held", "publisher_key")) == 1, F.get(distinct("held", "publisher_key"), F.lit(0))).alias("alone")), event, "left")
    theirs = F.coalesce("held", F.array().cast(dict(held.dtypes)["held"]))
    n = lambda where: F.size(F.filter("picks", where)).cast("long")
    each = picked.select(*story, _judged(F.col("picks"), theirs, F.col("alone")).alias("picks")).select(
        *story, F.size("picks").alias("n"), F.size(distinct("picks", "id", None)).alias("n_ids"), F.size(distinct("picks", "url", None)).alias("n_urls"), n(lambda p: p["changed"]).alias("changed"),
        n(_article).alias("n_articles"), n(lambda p: p["relationship"] == "originating").alias("n_origins"), F.size(distinct("picks", "url")).alias("n_article_urls"),
        distinct("picks", "publisher_key").alias("keys"), n(lambda p: (p["relationship"] == "context") & p["of_publisher"]).alias("n_contexts"),
    )
    total, same = ["n", "changed", "n_articles", "n_origins", "n_contexts"], ["n_ids", "n_urls", "n_article_urls"]  # of a story that is told twice
    amounts = each.groupBy(*story).agg(*[F.sum(c).alias(c) for c in total], *[F.max(c).alias(c) for c in same], F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("n_publishers"))
    two = (F.col("n_articles") >= 2) & (F.col("n_publishers") >= 2) & (F.col("n_article_urls") >= 2)
    one = (F.col("n_articles") == 1) & (F.col("n_origins") == 1) & (F.col("n_publishers") == 1) & (F.col("n_contexts") >= 1)
    few = F.coalesce((F.col("n") < 2) | (F.col("n_urls") < 2), F.lit(True))
    code = _first(
        ("EVENT_UNKNOWN", F.col("dossiers").isNull()), ("EVENT_REUSED", F.col("position") > F.col("taken")), ("DESK_WRONG", ~_same("desk", "c_desk")),
        ("DOSSIER_SOURCE_REPEATED", F.col("ids_repeat")), ("EVENT_UNCORROBORATED", ~F.col("is_corroborated") & ~F.col("is_single")), ("SOURCES_TOO_FEW", few),
        ("SOURCE_CHANGED", F.col("changed") > 0), ("SOURCE_REPEATED", F.col("n") > F.col("n_ids")),
        ("CORROBORATION_LACKING", F.col("is_corroborated") & ~two), ("AUTHORITATIVE_LIMITS", ~F.col("is_corroborated") & ~one),
    )
    row = lambda df, scope, key, c: df.select("edition", F.lit(scope).alias("scope"), F.col(key).cast("string").alias("key"), c.alias("code"))
    out = row(told.join(amounts, story, "left"), "story", "story", code)
    out = out.union(row(supply.where("dossiers > 1"), "candidate", "event_key", F.lit("DOSSIER_REPEATED")))
    if required is not None:
        asked = required.groupBy(*event).agg(F.count("*").alias("times")).withColumn("asked", F.lit(True))
        used = stories.join(supply, event, "left_semi").select(*event).distinct().withColumn("used", F.lit(True))
        seen = asked.join(supply.select(*event, "dossiers"), event, "left").join(used, event, "full_outer")
        wanted = required.select("edition").distinct().withColumn("wanted", F.lit(True))
        seen = seen.join(wanted, "edition", "left")
        fault = _first(
            ("REQUIRED_REPEATED", F.col("times") > 1), ("REQUIRED_UNKNOWN", F.col("asked") & F.col("dossiers").isNull()),
            ("REQUIRED_UNUSED", F.col("asked") & F.col("used").isNull()), ("NOT_REQUIRED", F.col("wanted") & F.col("asked").isNull()),
        )
        out = out.union(row(seen, "event", "event_key", fault))
    return out.where("code IS NOT NULL")
