"""Rules of whole edition documents (Q01) and of a newsroom's draft (Q02), as rows of what they break.

Both read rows of sources.editions.EDITION. A field that a document lacks and one that is null are the same to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.numbers import public_ipv4
from deskloom.functions.prose import prose_codes
from deskloom.functions.text import canonical_url, word_count
from deskloom.functions.times import local_clock, real_date, strict_instant
from deskloom.operators.integrity import codes

#: Words of a story's three paragraphs, and fields that readers see.
LEAST_WORDS, MOST_WORDS = 150, 225
READ = ["headline", "deck", "whatHappened", "whyItMatters", "whatToDoOrWatch"]
# Levels of verification; hosts of searches; names and endings of hosts that are not public; tracking parameters.
VERIFICATION = ["confirmed", "company-claimed", "preliminary", "disputed"]
SEARCH_HOSTS = ["bing.com", "duckduckgo.com", "google.com", "search.yahoo.com", "www.bing.com", "www.google.com"]
PRIVATE_SUFFIXES = [".home", ".internal", ".lan", ".local", ".localhost"]
PRIVATE_HOSTS = ["home", "internal", "lan", "local", "localhost"]
LINK_TRACKING = r"^(?:utm_.+|fbclid|gclid|msclkid|mc_cid|mc_eid)$"


def said(text: Column) -> Column:
    """Whether a text says anything."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def _pages(edition: DataFrame) -> DataFrame:
    """edition with `page`, a desk's, and `desk`, for each of the desks; a desk that is missing has a null page."""
    keys = F.array(*[F.lit(d) for d in V.DESKS])
    return edition.withColumn("desk", F.explode(keys)).withColumn("page", F.element_at("desks", F.col("desk")))


def _windows(editions: DataFrame) -> DataFrame:
    at = lambda c: strict_instant(F.col(c))
    return editions.withColumns(
        {
            "start": at("reportingWindow.startInclusive"), "end": at("reportingWindow.endExclusive"),
            "generated": at("publication.generatedAt"), "publish": at("publication.publishAt"),
        }
    )


def edition_issues(editions: DataFrame, prefix: str | None = None, provenance: tuple[str, str, str] | None = None, workflow: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """Q01: (editionDate, scope, code) for every rule that an edition or one of its stories breaks.

    prefix: what an id has before "-" and the date; provenance: the versions of policy, prompt and pipeline; workflow: that of
    automatic editions. What is None is not asked for. Without its desks an edition is judged no further.
    """
    date = F.col("editionDate")
    e = _windows(editions)
    keys = F.array(*[F.lit(d) for d in V.DESKS])
    pages = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at("desks", k).alias("page"))), lambda p: (p["page"]["desk"] == p["key"]) & p["page"]["story"].isNotNull())
    e = e.withColumn("pages", pages).withColumn("told", F.transform("pages", lambda p: p["page"]["story"])).withColumn("ids", F.transform("told", lambda s: s["id"]))
    entities = F.filter(F.transform("told", lambda s: F.lower(F.trim(s["editorial"]["primaryEntity"]))), lambda x: x != "")
    repeats = F.size(F.array_distinct(entities)) < F.size(entities)
    excused = said(F.col("frontPage.diversityException"))
    order, watch = F.coalesce("frontPage.storyOrder", F.array().cast("array<string>")), F.col("backPage.watchNext")
    window = F.coalesce(F.col("start") < F.col("end"), F.lit(False))
    clock = lambda c: F.substring(local_clock(F.col(c)), 12, 5)
    day = lambda c: F.substring(local_clock(F.col(c)), 1, 10)
    on_time = F.coalesce(clock("publish") == "06:00", F.lit(False))
    published = F.col("status") == "published"
    desks = F.coalesce(F.array_sort(F.map_keys("desks")) == F.array(*[F.lit(x) for x in sorted(V.DESKS)]), F.lit(False))
    first = codes(
        SCHEMA_VERSION=F.col("schemaVersion") == 2,
        EDITION_DATE=real_date(date).isNotNull(),
        EDITION_ID=F.col("id") == F.concat(F.lit(f"{prefix}-"), date) if prefix else F.col("id").endswith(F.concat(F.lit("-"), date)),
        ISSUE_NUMBER=F.col("issueNumber") > 0,
        STATUS=F.col("status").isin("draft", "validated", "published"),
        TIMEZONE=F.col("timezone") == "America/New_York",
        DESKS=desks,
    )
    alert = F.get(F.filter("told", lambda s: s["id"] == F.col("frontPage.stopThePressesStoryId")), F.lit(0))
    auto, check, p = F.col("provenance.automation"), F.col("provenance.sourceCheck"), F.col("provenance")
    known = F.lit(True) if provenance is None else (p["policyVersion"] == provenance[0]) & (p["promptVersion"] == provenance[1]) & (p["pipelineVersion"] == provenance[2])
    run = F.regexp_extract(auto["runUrl"], r"^https://github\.com/[^/?#]+/[^/?#]+/actions/runs/([1-9]\d*)$", 1)
    automatic = (
        (auto["workflow"] == workflow if workflow else F.lit(True)) & auto["runId"].rlike(r"^[1-9]\d*$") & (run == auto["runId"]) & auto["candidate"]
        & strict_instant(auto["generatedAt"]).isNotNull() & (auto["generatedAt"] == F.col("publication.generatedAt")) & auto["pilotSequence"].between(1, 5)
    )
    checked = (
        published & (F.col("publication.publishedAt") == F.col("publication.publishAt")) & (check["status"] == "passed") & strict_instant(check["checkedAt"]).isNotNull()
        & (check["checkedSourceCount"] >= 0) & (F.size(check["issues"]) == 0) & (F.size(watch) == 0)
    )
    rest = codes(
        WINDOW=window,
        WINDOW_END=~window | ((clock("end") == "05:00") & (day("end") == date)),
        TARGET_TIME=F.col("publication.targetLocalTime") == "06:00",
        GENERATED_AT=F.col("generated").isNotNull(),
        PUBLISH_TIME=on_time,
        PUBLISH_DATE=~on_time | (day("publish") == date),
        PUBLISHED_AT=F.when(published, strict_instant(F.col("publication.publishedAt")).isNotNull()).otherwise(F.col("publication.publishedAt").isNull()),
        AI_ADJACENT=F.size(F.filter("told", lambda s: s["editorial"]["aiAdjacent"])) <= 2,
        REPEATED_ENTITY=~repeats | excused,
        NEEDLESS_EXCEPTION=repeats | F.col("frontPage.diversityException").isNull(),
        STORY_ORDER=(F.size(order) == F.size("ids")) & (F.size(F.array_distinct(order)) == F.size(order)) & (F.size(F.array_except(order, "ids")) == 0),
        LEAD_STORY=~said(F.col("frontPage.leadStoryId")) | F.array_contains("ids", F.col("frontPage.leadStoryId")),
        STOP_THE_PRESSES=F.col("frontPage.stopThePressesStoryId").isNull() | ((alert["desk"] == "security-and-privacy") & alert["securityAction"].isNotNull()),
        WATCH_NEXT=watch.isNotNull(),
        WATCH_NEXT_SIZE=watch.isNull() | (F.size(watch) <= 3),
        WATCH_NEXT_ITEM=watch.isNull() | F.forall(watch, lambda w: said(w["topic"]) & said(w["unresolved"]) & said(w["meaningfulSignal"]) & said(w["whyItMatters"])),
        PROVENANCE=known,
        AUTOMATION=auto.isNull() | automatic,
        AUTOMATION_CHECK=auto.isNull() | checked,
    )
    whole = F.concat(first, F.when(desks, rest).otherwise(F.array().cast("array<string>")))
    own = F.array(F.lit(None).cast("string"))  # a document is read once: a row of its own, then one for each desk
    rows = e.withColumn("desk", F.explode(F.when(desks, F.concat(own, keys)).otherwise(own)))
    rows = rows.withColumn("page", F.element_at("desks", F.col("desk"))).withColumn("place", F.array_position(keys, F.col("desk")))
    labelled = F.coalesce(F.col("page.desk") == F.col("desk"), F.lit(False))
    page = codes(DESK_PAGE=labelled, EMPTY_REASON=~labelled | F.col("page.story").isNotNull() | said(F.col("page.emptyReason")))
    s = lambda c: F.col(f"page.story.{c}")
    earlier = lambda c: F.exists("pages", lambda p: (F.array_position(keys, p["key"]) < F.col("place")) & (p["page"]["story"][c] == s(c)))
    fresh = lambda c: said(s(c)) & ~F.coalesce(earlier(c), F.lit(False))
    at = strict_instant(F.coalesce(s("timing.eventAt"), s("timing.firstPublishedAt")))
    again = strict_instant(s("timing.materiallyUpdatedAt"))
    inside = lambda x: F.coalesce((x >= F.col("start")) & (x < F.col("end")), F.lit(False))
    update = F.coalesce(s("status") == "material-update", F.lit(False))
    judged = F.coalesce(F.size(s("sources")) > 0, F.lit(False))
    names = F.transform(s("sources"), lambda x: x["id"])
    cited = F.flatten(F.transform(s("evidence"), lambda c: F.coalesce(c["sourceIds"], F.array().cast("array<string>"))))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    filed = s("editorial").isNotNull()
    story = codes(
        STORY_DESK=s("desk") == F.col("desk"),
        STORY_ID=fresh("id"),
        EVENT_KEY=fresh("canonicalEventKey"),
        SCORE=s("selection.score").between(V.MINIMUM_SCORE, 100),
        EDITORIAL=filed,
        ENTITY=~filed | said(s("editorial.primaryEntity")),
        AI_DECLARED=~filed | s("editorial.aiAdjacent").isNotNull(),
        MATURITY=~filed | (s("editorial.maturity") == "verified-development"),
        DESK_FIT=~filed | said(s("editorial.deskFit")),
        AI_DESK=~filed | (s("desk") != "ai") | s("editorial.aiAdjacent"),
        **{f"READER_COPY_{c.upper()}": F.size(prose_codes(s(c))) == 0 for c in READ},
        WORDS=word_count(F.concat_ws(" ", *[s(c) for c in READ[2:]])).between(least_words, MOST_WORDS),
        UPDATE_TIME=~update | inside(again),
        DELTA=~update | said(s("selection.materialDelta")),
        IN_WINDOW=update | inside(at),
        SOURCES=judged,
        SOURCE_IDS=~judged | ((F.size(F.array_distinct(names)) == F.size(names)) & F.forall(names, said)),
        SOURCE_URLS=~judged | F.forall(s("sources"), lambda x: (host(x["url"]) != "") & ~host(x["url"]).isin("google.com", "www.google.com", "bing.com", "www.bing.com")),
        SOURCE_KIND=~judged | F.exists(s("sources"), lambda x: x["relationship"].isin("originating", "independent")),
        CLAIM_SOURCES=~judged | s("evidence").isNull() | F.forall(s("evidence"), lambda c: F.coalesce(F.size(c["sourceIds"]) > 0, F.lit(False))),
        CLAIM_UNKNOWN=~judged | s("evidence").isNull() | (F.size(F.array_except(cited, names)) == 0),
        SECURITY_DESK=~judged | s("securityAction").isNull() | (s("desk") == "security-and-privacy"),
    )
    found = F.when(F.col("desk").isNull(), whole).when(labelled & F.col("page.story").isNotNull(), F.concat(page, story)).otherwise(page)
    return rows.select("editionDate", F.coalesce("desk", F.lit("edition")).alias("scope"), F.explode(found).alias("code"))


def _public(address: Column) -> Column:
    """Whether a literal address in a url is public: P04 for version 4; of version 6, global unicast but for reserved blocks."""
    reserved = address.rlike(r"^(?:2001:0*1?[0-9a-f]{0,2}|2001:0?db8|2002|3fff)(?::|$)")
    return F.when(address.contains(":"), address.rlike("^[23][0-9a-f]{3}:") & ~reserved).otherwise(public_ipv4(address))


def source_url_code(url: Column) -> Column:
    """Q02: the first thing wrong with a source's url, else null."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]+)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""), r"\.$", ""))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    private = host.isin(PRIVATE_HOSTS)
    for ending in PRIVATE_SUFFIXES:
        private = private | host.endswith(ending)
    address = bare.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | bare.contains(":")
    return (
        F.when(F.coalesce(authority, F.lit("")) == "", "SOURCE_URL_INVALID")
        .when(~F.lower(url).startswith("https://"), "SOURCE_URL_NOT_HTTPS")
        .when(authority.contains("@"), "SOURCE_URL_CREDENTIALS")
        .when(private | (address & ~F.coalesce(_public(bare), F.lit(False))), "SOURCE_URL_PRIVATE_HOST")
        .when(host.isin(SEARCH_HOSTS), "SOURCE_URL_SEARCH_PAGE")
    )


def _blank(parent: str, fields: list[str], asked: Column | None = None) -> list[Column]:
    """EDITORIAL_TEXT_MISSING with the field's name, for each field that says nothing."""
    asked = F.lit(True) if asked is None else asked
    return [F.when(asked & ~said(F.col(f"{parent}.{f}")), F.struct(F.lit(f).alias("at"), F.lit("EDITORIAL_TEXT_MISSING").alias("code"))) for f in fields]


def _failed(at: str, **checks: Column) -> list[Column]:
    """(at, code) for the checks that fail or can't be made."""
    return [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(at).alias("at"), F.lit(name).alias("code"))) for name, ok in checks.items()]


def _rows(df: DataFrame, scope: Column, found: list[Column]) -> DataFrame:
    rows = df.select("editionDate", scope.alias("__scope"), F.explode(F.array_compact(F.array(*found))).alias("__found"))
    place = F.when(F.col("__found.at") == "", F.col("__scope")).otherwise(F.concat_ws(".", "__scope", "__found.at"))
    return rows.select("editionDate", place.alias("scope"), F.col("__found.code").alias("code"))


def newsroom_issues(editions: DataFrame, allowed: DataFrame | None = None, prior: DataFrame | None = None, backfill: bool = False, empty_watch: bool = True) -> DataFrame:
    """Q02: (editionDate, scope, code) for every rule that a draft edition breaks; the scope is the place in the document.

    allowed: (url) that a source may cite, in canonical form; prior: (event_key) that earlier editions covered. backfill lifts
    the rules that hold times against the scheduled publication. Each source and each claim is a row of its own, and urls
    and events are looked up by joins.
    """
    e = _windows(editions)
    window = F.coalesce(F.col("start") < F.col("end"), F.lit(False))
    published, dated = F.col("status") == "published", strict_instant(F.col("publication.publishedAt")).isNotNull()
    trial, watch = F.col("backPage.tryThisTomorrow"), F.col("backPage.watchNext")
    whole = _failed(
        "",
        REPORTING_WINDOW_INVALID=window, GENERATED_AT_INVALID=F.col("generated").isNotNull(), PUBLISH_AT_INVALID=F.col("publish").isNotNull(),
        GENERATED_AFTER_PUBLICATION=F.lit(backfill) | F.coalesce(F.col("generated") <= F.col("publish"), F.lit(True)),
        PUBLISHED_AT_MISSING=~F.coalesce(published, F.lit(False)) | dated,
        UNPUBLISHED_HAS_PUBLISHED_AT=~F.col("status").isin("draft", "validated") | F.col("publication.publishedAt").isNull(),
        DESKS_MISSING=F.col("desks").isNotNull(),
        EXPERIMENT_STEPS_INVALID=trial.isNull() | trial["steps"].isNotNull(),
    ) + _blank("frontPage", ["note"]) + _blank("backPage.tryThisTomorrow", ["title", "goal", "successMeasure", "riskCheck"], trial.isNotNull())
    whole.append(F.when(F.coalesce(F.exists(trial["steps"], lambda x: ~said(x)), F.lit(False)), F.struct(F.lit("steps").alias("at"), F.lit("EDITORIAL_TEXT_MISSING").alias("code"))))
    if empty_watch:
        whole += _failed("watchNext", WATCH_NEXT_INVALID=watch.isNotNull(), WATCH_NEXT_UNSOURCED=watch.isNull() | (F.size(watch) == 0))
    out = _rows(e, F.lit("edition"), whole)
    pages = _pages(e)
    has = F.col("page").isNotNull()
    out = out.unionByName(_rows(pages, F.col("desk"), _failed("", DESK_MISSING=has) + _blank("page", ["emptyReason"], has & F.col("page.story").isNull())))
    stories = pages.where("page.story IS NOT NULL").select("editionDate", "desk", "start", "end", "generated", "publish", F.col("page.story").alias("s"))
    known = stories.withColumn("repeated", F.lit(False))
    if prior is not None:
        keys = prior.select(F.col("event_key").alias("k")).where("k IS NOT NULL").distinct().withColumn("covered", F.lit(True))
        known = stories.join(keys, F.col("s.canonicalEventKey") == F.col("k"), "left").withColumn("repeated", F.coalesce("covered", F.lit(False)))
    out = out.unionByName(_rows(known, F.col("desk"), _story_rules()))
    sources = stories.select("editionDate", "desk", "generated", "publish", F.posexplode("s.sources").alias("i", "x"), F.slice(F.transform("s.sources", lambda x: x["id"]), 1, F.col("i")).alias("earlier"))
    if allowed is not None:
        sources = sources.withColumn("u", canonical_url(F.col("x.url"), LINK_TRACKING)).join(allowed.select(F.col("url").alias("u"), F.lit(True).alias("grounded")).distinct(), "u", "left")
    else:
        sources = sources.withColumn("grounded", F.lit(True))
    out = out.unionByName(_rows(sources, F.concat("desk", F.lit(".sources["), F.col("i").cast("string"), F.lit("]")), _source_rules(backfill)))
    claims = stories.select("editionDate", "desk", F.col("s.sources").alias("sources"), F.posexplode("s.evidence").alias("i", "x"), F.slice(F.transform("s.evidence", lambda x: x["id"]), 1, F.col("i")).alias("earlier"))
    return out.unionByName(_rows(claims, F.concat("desk", F.lit(".evidence["), F.col("i").cast("string"), F.lit("]")), _claim_rules()))


def _story_rules() -> list[Column]:
    s = lambda c: F.col(f"s.{c}")
    at = lambda c: strict_instant(s(f"timing.{c}"))
    first, event, again = at("firstPublishedAt"), at("eventAt"), at("materiallyUpdatedAt")
    new, update = F.coalesce(s("status") == "new-development", F.lit(False)), F.coalesce(s("status") == "material-update", F.lit(False))
    fine = lambda ok: F.coalesce(ok, F.lit(True))
    inside = lambda x: fine((x >= F.col("start")) & (x < F.col("end")))
    urls = F.array_distinct(F.transform(F.filter(s("sources"), lambda x: source_url_code(x["url"]).isNull()), lambda x: canonical_url(x["url"], LINK_TRACKING)))
    kinds = F.transform(s("sources"), lambda x: x["relationship"])
    cited_ids = F.flatten(F.transform(s("evidence"), lambda c: F.coalesce(c["sourceIds"], F.array().cast("array<string>"))))
    cited = F.transform(F.filter(s("sources"), lambda x: F.array_contains(cited_ids, x["id"])), lambda x: x["relationship"])
    some = lambda kinds, *names: F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names])), F.lit(False))
    critical = F.coalesce(s("priority") == "critical", F.lit(False))
    both = lambda kinds: some(kinds, "originating") & some(kinds, "independent")
    action = s("securityAction").isNotNull()
    return (
        _blank("s", ["id", "canonicalEventKey", *READ]) + _blank("s.editorial", ["primaryEntity", "deskFit"]) + _blank("s.selection", ["selectedBecause"])
        + _blank("s.confidence", ["rationale"]) + _blank("s.securityAction", ["affected", "action"], action) + _blank("s.securityAction", ["deadline"], action & s("securityAction.deadline").isNotNull())
        + _failed(
            "",
            FIRST_PUBLISHED_AT_INVALID=first.isNotNull(),
            EVENT_AT_INVALID=s("timing.eventAt").isNull() | event.isNotNull(),
            MATERIAL_UPDATE_TIMESTAMP_MISSING=~update | again.isNotNull(),
            MATERIAL_UPDATE_OUTSIDE_WINDOW=~update | inside(again),
            MATERIAL_UPDATE_BEFORE_PUBLICATION=~update | fine(again >= first),
            MATERIAL_DELTA_MISSING=~update | said(s("selection.materialDelta")),
            NEW_DEVELOPMENT_OUTSIDE_WINDOW=~new | inside(F.coalesce(event, first)),
            NEW_DEVELOPMENT_HAS_UPDATE_TIMESTAMP=~new | s("timing.materiallyUpdatedAt").isNull(),
            NEW_DEVELOPMENT_HAS_MATERIAL_DELTA=~new | s("selection.materialDelta").isNull(),
            STORY_STATUS_INVALID=new | update,
            REPEATED_EVENT_NOT_MATERIAL_UPDATE=~F.col("repeated") | update,
            SOURCE_LIST_MISSING=F.size(s("sources")) > 0,
            INSUFFICIENT_DISTINCT_SOURCES=F.size(urls) >= 2,
            STORY_LACKS_AUTHORITATIVE_SOURCE=some(kinds, "originating", "independent"),
            CRITICAL_STORY_SOURCE_MIX=~critical | both(kinds),
            EVIDENCE_LIST_MISSING=F.size(s("evidence")) > 0,
            EVIDENCE_LACKS_AUTHORITATIVE_SOURCE=some(cited, "originating", "independent"),
            CRITICAL_STORY_EVIDENCE_MIX=~critical | both(cited),
        )
    )


def _source_rules(backfill: bool) -> list[Column]:
    x = lambda c: F.col(f"x.{c}")
    wrong = source_url_code(x("url"))
    published, retrieved = strict_instant(x("publishedAt")), strict_instant(x("retrievedAt"))
    fine = lambda ok: F.coalesce(ok, F.lit(True))
    return [
        *_failed(
            "",
            SOURCE_INVALID=F.col("x").isNotNull(),
            SOURCE_ID_MISSING=F.col("x").isNull() | said(x("id")),
            SOURCE_ID_DUPLICATE=~said(x("id")) | ~F.coalesce(F.array_contains("earlier", x("id")), F.lit(False)),
            SOURCE_METADATA_MISSING=F.col("x").isNull() | (said(x("title")) & said(x("publisher"))),
            SOURCE_RELATIONSHIP_INVALID=F.col("x").isNull() | x("relationship").isin(V.RELATIONSHIPS),
            SOURCE_URL_NOT_GROUNDED=F.col("x").isNull() | wrong.isNotNull() | F.col("grounded"),
            SOURCE_PUBLISHED_AT_INVALID=x("publishedAt").isNull() | published.isNotNull(),
            SOURCE_RETRIEVED_AT_INVALID=F.col("x").isNull() | retrieved.isNotNull(),
            SOURCE_RETRIEVED_BEFORE_PUBLICATION=fine(retrieved >= published),
            SOURCE_RETRIEVED_AFTER_GENERATION=fine(retrieved <= F.col("generated")),
            SOURCE_RETRIEVED_AFTER_PUBLICATION=F.lit(backfill) | fine(retrieved <= F.col("publish")),
        ),
        F.when(F.col("x").isNotNull() & wrong.isNotNull(), F.struct(F.lit("url").alias("at"), wrong.alias("code"))),
    ]


def _claim_rules() -> list[Column]:
    x = lambda c: F.col(f"x.{c}")
    ids, void = x("sourceIds"), F.col("x").isNull()
    listed = F.coalesce(F.size(ids) > 0, F.lit(False))
    named = F.filter(ids, said)
    theirs = F.transform(F.filter("sources", lambda s: F.array_contains(ids, s["id"]) & s["relationship"].isin(V.RELATIONSHIPS)), lambda s: s["relationship"])
    unknown = F.array_except(named, F.transform("sources", lambda s: s["id"]))
    return _failed(
        "",
        EVIDENCE_INVALID=~void,
        EVIDENCE_ID_MISSING=void | said(x("id")),
        EVIDENCE_ID_DUPLICATE=~said(x("id")) | ~F.coalesce(F.array_contains("earlier", x("id")), F.lit(False)),
        EVIDENCE_STATEMENT_MISSING=void | said(x("statement")),
        EVIDENCE_VERIFICATION_INVALID=void | x("verification").isin(VERIFICATION),
        EVIDENCE_SOURCE_IDS_MISSING=void | listed,
        EVIDENCE_SOURCE_ID_INVALID=~listed | (F.size(named) == F.size(ids)),
        EVIDENCE_SOURCE_ID_DUPLICATE=~listed | (F.size(F.array_distinct(named)) == F.size(named)),
        EVIDENCE_SOURCE_UNKNOWN=~listed | F.coalesce(F.size(unknown) == 0, F.size(named) == 0),
        CONFIRMED_CLAIM_CONTEXT_ONLY=F.coalesce(x("verification") != "confirmed", F.lit(True)) | ~listed | F.coalesce((F.size(theirs) == 0) | F.exists(theirs, lambda r: r != "context"), F.lit(True)),
    )
