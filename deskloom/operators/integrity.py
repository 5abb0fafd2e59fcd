"""Validators that list all that is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.prose import prose_codes, unsupported_names
from deskloom.functions.text import let, shares_run, unsupported_numbers, word_count


def codes(**checks: Column) -> Column:
    """The names of the checks that fail or can't be made, in the order given."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def shape_issues(json: Column, keys: list[str], optional: list[str] | None = None) -> Column:
    """Keys of a JSON object that are missing (-key) or unknown (+key)."""
    have = F.coalesce(F.json_object_keys(json), F.expr("cast(array() as array<string>)"))
    want, may = F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(k) for k in [*keys, *(optional or [])]])
    return F.concat(F.transform(F.array_except(want, have), lambda k: F.concat(F.lit("-"), k)), F.transform(F.array_except(have, may), lambda k: F.concat(F.lit("+"), k)))


def draft_issues(stories: DataFrame) -> DataFrame:
    """Q02: (id, code) for the timing and source rules of a draft's stories.

    stories: id, status, event_at, first_published_at, material_update_at, material_delta, window_start, window_end,
    generated_at, publish_at (instants), critical boolean, prior boolean, sources array<struct<id, url, relationship,
    published_at, retrieved_at>>.
    """
    start, end = F.col("window_start"), F.col("window_end")
    new, update = F.col("status") == "new-development", F.col("status") == "material-update"
    at = F.coalesce("event_at", "first_published_at")
    inside = lambda x: (x >= start) & (x < end)
    sources, has = F.col("sources"), lambda r: F.exists(F.col("sources"), lambda x: x["relationship"] == r)
    urls = F.array_distinct(F.transform(sources, lambda x: F.lower(F.regexp_replace(x["url"], r"[#?].*$|/$", ""))))
    checks = codes(
        STORY_STATUS_INVALID=new | update,
        NEW_DEVELOPMENT_OUTSIDE_WINDOW=~new | inside(at),
        NEW_DEVELOPMENT_HAS_UPDATE_TIMESTAMP=~new | F.col("material_update_at").isNull(),
        NEW_DEVELOPMENT_HAS_MATERIAL_DELTA=~new | F.col("material_delta").isNull(),
        MATERIAL_UPDATE_TIMESTAMP_MISSING=~update | F.col("material_update_at").isNotNull(),
        MATERIAL_UPDATE_OUTSIDE_WINDOW=~update | F.coalesce(inside(F.col("material_update_at")), F.lit(True)),
        MATERIAL_UPDATE_BEFORE_PUBLICATION=~update | F.coalesce(F.col("material_update_at") >= F.col("first_published_at"), F.lit(True)),
        MATERIAL_DELTA_MISSING=~update | (F.length(F.trim("material_delta")) > 0),
        REPEATED_EVENT_NOT_MATERIAL_UPDATE=~F.col("prior") | update,
        SOURCE_LIST_MISSING=F.size(sources) > 0,
        SOURCE_ID_DUPLICATE=F.size(F.array_distinct(F.transform(sources, lambda x: x["id"]))) == F.size(sources),
        SOURCE_RELATIONSHIP_INVALID=F.forall(sources, lambda x: x["relationship"].isin(V.RELATIONSHIPS)),
        SOURCE_URL_NOT_HTTPS=F.forall(sources, lambda x: x["url"].startswith("https://")),
        SOURCE_RETRIEVED_BEFORE_PUBLICATION=F.forall(sources, lambda x: x["published_at"].isNull() | (x["published_at"] <= x["retrieved_at"])),
        SOURCE_RETRIEVED_AFTER_GENERATION=F.forall(sources, lambda x: x["retrieved_at"] <= F.col("generated_at")),
        GENERATED_AFTER_PUBLICATION=F.col("generated_at") <= F.col("publish_at"),
        INSUFFICIENT_DISTINCT_SOURCES=F.size(urls) >= 2,
        STORY_LACKS_AUTHORITATIVE_SOURCE=has("originating") | has("independent"),
        CRITICAL_STORY_SOURCE_MIX=~F.col("critical") | (has("originating") & has("independent")),
    )
    return stories.select("id", F.explode(checks).alias("code"))


def source_issues(sources: DataFrame) -> DataFrame:
    """Q05: (source_id, code) for rows (source_id, status, code, parsed, eligible) of a snapshot that can't be true."""
    status, none = F.col("status"), (F.col("parsed") == 0) & (F.col("eligible") == 0)
    checks = codes(
        STATUS_UNKNOWN=status.isin("ok", "failed", "not-observed"),
        COUNT_INVALID=(F.col("parsed") >= 0) & (F.col("eligible") >= 0),
        COUNTS_INCONSISTENT=F.col("eligible") <= F.col("parsed"),
        OK_WITH_CODE=(status != "ok") | F.col("code").isNull(),
        FAILED_NOT_SAFE=(status != "failed") | (F.coalesce(F.col("code").isin(V.FAILURE_CODES), F.lit(False)) & none),
        UNOBSERVED_NOT_SAFE=(status != "not-observed") | (F.col("code").isNull() & none),
    )
    return sources.select("source_id", F.explode(checks).alias("code"))


def total_issues(sources: DataFrame, declared: DataFrame, group: str) -> DataFrame:
    """Q05: (group, code) where a snapshot's declared totals (ok, failed, parsed, eligible) are not those of its sources."""
    ok = F.col("status") == "ok"
    own = sources.groupBy(F.col(group).alias("g")).agg(F.count_if(ok).alias("own_ok"), F.count_if(F.col("status") == "failed").alias("own_failed"), F.sum("parsed").alias("own_parsed"), F.sum("eligible").alias("own_eligible"))
    met = declared.join(own, F.col(group) == F.col("g"), "left")
    same = {f"{c.upper()}_TOTAL": F.col(c) == F.coalesce(F.col(f"own_{c}"), F.lit(0)) for c in ("ok", "failed", "parsed", "eligible")}
    return met.select(group, F.explode(codes(**same)).alias("code"))


def receipt_valid(receipt: Column, provider: str = "tavily") -> Column:
    """Q08: whether a JSON receipt of searches has exactly its four keys and counters within their bounds, two credits a query."""
    known = F.array(*[F.lit(k) for k in ("admittedArticles", "creditsReserved", "provider", "queriesUsed")])
    whole = lambda k: F.when(F.get_json_object(receipt, f"$.{k}").rlike(r"^-?\d+$"), F.get_json_object(receipt, f"$.{k}").try_cast("long"))
    used, credits, admitted = whole("queriesUsed"), whole("creditsReserved"), whole("admittedArticles")
    fine = (
        (F.array_sort(F.json_object_keys(receipt)) == known) & (F.get_json_object(receipt, "$.provider") == provider)
        & used.between(1, V.MAX_SEARCHES) & (credits == 2 * used) & admitted.between(0, V.MAX_ADMITTED)
    )
    return F.coalesce(fine, F.lit(False))


def tier_issues(groups: DataFrame, declared: str, recomputed: str) -> DataFrame:
    """Q04: groups with whether the declared tier is the one that their evidence gives."""
    return groups.withColumn("agrees", F.col(declared).eqNullSafe(F.col(recomputed)))


def link_checks(links: DataFrame, results: DataFrame, url: Column) -> DataFrame:
    """Q03: each link with the result of the one check of its normalized url; unchecked ones say so."""
    keyed = links.withColumn("checked_url", url)
    return keyed.join(results, "checked_url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("LINK_REQUEST_UNAVAILABLE")))


def summary_issues(rows: DataFrame, key: str, summary: str, source: str, words: tuple[int, int] = (40, 220), copied: int = 12) -> DataFrame:
    """Q10: (key, code) for summaries of a wrong length, with numbers or names that their source lacks, or copied runs.

    Runs meet by hashes of their words; only where two do, the runs themselves are compared.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    s, x = F.col(summary), F.col(source)
    checks = codes(
        WORD_RANGE=word_count(s).between(*words),
        UNSUPPORTED_NUMBERS=F.size(unsupported_numbers(s, x)) == 0,
        UNSUPPORTED_NAMES=F.size(unsupported_names(s, x)) == 0,
        COPIED_RUN=~let(F.struct(tokens(s).alias("s"), tokens(x).alias("x")), lambda w: shares_run(w["s"], w["x"], copied)),
        PROSE=F.size(prose_codes(s, paragraph=True)) == 0,
    )
    return rows.select(key, F.explode(checks).alias("code"))
