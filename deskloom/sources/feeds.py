"""Feed scans (S01-S07, S17): bodies land as files, one row each, and become item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.text import canonical_url, clean_text, stable_id
from deskloom.functions.times import parse_instant
from deskloom.operators.ranking import fair_sample, top_k

_LINK = "array<struct<_VALUE:string,_rel:string,_href:string>>"
_TERM = "array<struct<_VALUE:string,_term:string>>"
_RSS = "guid:struct<_VALUE:string>,title:string,link:string,description:string,summary:string,`content:encoded`:string,pubDate:string,published:string,date:string,updated:string,category:array<string>"
_ATOM = f"id:string,title:string,link:{_LINK},published:string,updated:string,summary:string,content:string,category:{_TERM}"
XML_SCHEMA = f"channel struct<item:array<struct<{_RSS}>>>, entry array<struct<{_ATOM}>>"
JSON_SCHEMA = "items array<struct<id:string,url:string,external_url:string,title:string,summary:string,content_text:string,content_html:string,date_published:string,date_modified:string,tags:array<string>>>"
#: Columns of a parsed entry before normalization.
RAW = ["position", "guid", "title", "url", "summary", "published", "updated", "categories"]


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed response bodies, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_id"), F.col("value").alias("body"))


def fetch_code(hops: Column, status: Column, content_type: Column, encoding: Column, octets: Column, kind: str, hosts: list[str]) -> Column:
    """The code of the rule that a landed response breaks, else null; hops are the urls asked for, in order.

    The fetch itself happens outside; what it landed is judged here, before its body is parsed.
    """
    authority = lambda u: F.regexp_extract(u, r"^https://([^/?#]*)", 1)
    plain = lambda u: (authority(u) != "") & ~authority(u).contains("@") & ~authority(u).rlike(r":(?!443$)")
    listed = lambda u: F.lower(F.regexp_replace(authority(u), ":443$", "")).isin(hosts)
    return (
        F.when(F.coalesce(F.size(hops), F.lit(0)) < 1, "URL_INVALID")
        .when(~F.coalesce(F.forall(hops, plain), F.lit(False)), "URL_UNSAFE")
        .when(~F.forall(hops, listed), "HOST_NOT_ALLOWED")
        .when(F.exists(hops, lambda u: F.length(u) > V.MAX_URL), "URL_TOO_LONG")
        .when(F.size(hops) - 1 > V.MAX_REDIRECTS, "REDIRECT_LIMIT")
        .when(status.isNull(), "STATUS_INVALID")
        .when(~status.between(200, 299), "HTTP_STATUS")
        .when(F.lower(F.coalesce(encoding, F.lit("identity"))) != "identity", "ENCODING_UNSUPPORTED")
        .when(octets > V.MAX_FEED_BYTES, "BODY_TOO_LARGE")
        .when(~F.coalesce(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin(V.FEED_TYPES[kind]), F.lit(False)), "CONTENT_TYPE_INVALID")
    )


_ELEMENT = r"(?i)</?[a-z][^>]*>"


def nesting(body: Column) -> Column:
    """The greatest number of elements that are open at once, by tags alone; closing tags too many count for nothing."""
    step = F.transform(F.regexp_extract_all(body, F.lit(_ELEMENT), F.lit(0)), lambda t: F.when(t.startswith("</"), -1).when(t.rlike(r"/\s*>$"), 0).otherwise(1))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deeper = lambda a, s: F.struct(F.greatest(F.lit(0), a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most"))
    return F.aggregate(step, none, deeper, lambda a: a["most"])


def gate(body: Column, kind: Column) -> Column:
    """The code of the limit that a body breaks, else null."""
    xml = kind == "xml"
    return (
        F.when(body.isNull() | (F.trim(body) == ""), "BODY_INVALID")
        .when(F.octet_length(body) > V.MAX_FEED_BYTES, "BODY_TOO_LARGE")
        .when(xml & body.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), "XML_DTD_REJECTED")
        .when(xml & (F.regexp_count(body, F.lit(_ELEMENT)) > V.MAX_TAGS), "XML_COMPLEXITY")
        .when(xml & (nesting(body) > V.MAX_DEPTH), "XML_COMPLEXITY")
        .when(xml & ~body.rlike(r"(?i)<(?:rss|feed|rdf:rdf)[\s>]"), "XML_SHAPE_INVALID")
        .when(~xml & F.from_json(body, JSON_SCHEMA)["items"].isNull(), "JSON_SHAPE_INVALID")
    )


def parse_xml(bodies: DataFrame, body: str = "body", cap: int = V.MAX_ENTRIES) -> DataFrame:
    """The first entries of RSS and Atom bodies as raw rows, other columns kept."""
    text = lambda e, *names: F.coalesce(*[F.when(F.trim(e[n]) != "", e[n]) for n in names])
    rss = lambda e, i: F.struct(
        i.alias("position"), e["guid"]["_VALUE"].alias("guid"), e["title"].alias("title"), e["link"].alias("url"),
        text(e, "description", "summary", "content:encoded").alias("summary"), text(e, "pubDate", "published", "date").alias("published"),
        e["updated"].alias("updated"), e["category"].alias("categories"),
    )
    usable = lambda e: F.filter(e["link"], lambda n: n["_href"].isNotNull() & (n["_rel"].isNull() | (n["_rel"] == "alternate")))
    atom = lambda e, i: F.struct(
        i.alias("position"), e["id"].alias("guid"), e["title"].alias("title"), F.get(usable(e), F.lit(0))["_href"].alias("url"),
        text(e, "summary", "content").alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published"),
        e["updated"].alias("updated"), F.transform(e["category"], lambda c: F.coalesce(c["_term"], c["_VALUE"])).alias("categories"),
    )
    x = bodies.withColumn("__x", F.from_xml(F.col(body), XML_SCHEMA))
    found = F.array(F.transform(F.slice("__x.channel.item", 1, cap), rss), F.transform(F.slice("__x.entry", 1, cap), atom))
    return x.select(*bodies.columns, F.inline(F.flatten(F.filter(found, lambda f: f.isNotNull()))))


def parse_json(bodies: DataFrame, body: str = "body", cap: int = V.MAX_ENTRIES) -> DataFrame:
    """The first items of JSON feeds as raw rows."""
    x = bodies.withColumn("__x", F.from_json(F.col(body), JSON_SCHEMA))
    rows = x.select(*bodies.columns, F.posexplode(F.slice("__x.items", 1, cap)).alias("position", "e"))
    return rows.select(
        *bodies.columns, "position", F.col("e.id").alias("guid"), "e.title", F.coalesce("e.url", "e.external_url").alias("url"),
        F.coalesce("e.summary", "e.content_text", "e.content_html").alias("summary"), F.col("e.date_published").alias("published"),
        F.col("e.date_modified").alias("updated"), F.col("e.tags").alias("categories"),
    )


def normalize(raw: DataFrame, source: str = "source_id") -> DataFrame:
    """Items with a title, a url and an instant; updates not before publication; at most 12 distinct categories."""
    url = canonical_url(clean_text(F.col("url"), 2048))
    published, updated = parse_instant(F.trim("published")), parse_instant(F.trim("updated"))
    kept = F.filter(F.array_distinct(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: clean_text(c, 120))), lambda c: c != "")
    needed = F.struct(clean_text(F.col("title"), 240).alias("__title"), url.alias("__url"), published.alias("__at"))
    rows = raw.select("*", F.inline(F.array(needed)))  # made once: a filter on them would otherwise make them before and again after it
    rows = rows.where("__title <> '' AND __url IS NOT NULL AND __at IS NOT NULL").select(
        F.col(source), F.col("position").alias("feed_position"), F.coalesce(F.when(F.trim("guid") != "", F.trim("guid")), F.col("__url")).alias("guid"),
        F.col("__title").alias("title"), F.col("__url").alias("url"), F.coalesce(clean_text(F.col("summary"), 1200), F.lit("")).alias("summary"),
        F.col("__at").alias("published_at"), F.when(updated >= F.col("__at"), updated).alias("updated_at"), F.slice(kept, 1, V.MAX_CATEGORIES).alias("categories"),
    )
    return rows.withColumn("item_id", stable_id(F.col(source), F.col("guid")))


def ingest(sources: DataFrame, bodies: DataFrame, total: int = V.MAX_TOTAL_BYTES) -> DataFrame:
    """A row per source in order: status and code; a body counts against the budget in the sources' order."""
    met = sources.join(bodies, "source_id", "left").withColumn("code", gate(F.col("body"), F.col("format")))
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    running = F.sum(size).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))  # one row per source: a dimension
    met = met.withColumn("bytes", size.cast("long")).withColumn("running", running)
    code = F.coalesce("code", F.when(F.col("running") > total, "TOTAL_BODY_LIMIT"))
    return met.select("idx", "source_id", F.when(code.isNull(), "ok").otherwise("failed").alias("status"), code.alias("code"), "bytes")


def ingested_items(ingested: DataFrame, parsed: DataFrame, total: int = V.MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(sources, items): a source without a parsed item has failed, and of the others' items at most `total` are taken.

    parsed: normalize()'s rows. Sources take turns, each with its latest item first, so that none crowds out the others.
    """
    counts = parsed.groupBy("source_id").agg(F.count("*").alias("parsed"))
    met = ingested.join(counts, "source_id", "left").withColumn("parsed", F.when(F.col("status") == "ok", F.coalesce("parsed", F.lit(0))).otherwise(0))
    void = (F.col("status") == "ok") & (F.col("parsed") == 0)
    sources = met.withColumn("code", F.when(void, "FEED_EMPTY_OR_UNPARSEABLE").otherwise(F.col("code"))).withColumn("status", F.when(void, "failed").otherwise(F.col("status")))
    fine = parsed.join(sources.where("status = 'ok'").select("source_id"), "source_id", "left_semi")
    return sources, fair_sample(fine, "source_id", [F.desc("published_at"), F.asc("item_id")], total)


def single_flight(asked: DataFrame, key: str, order: str, most: int = V.MAX_FETCHES) -> DataFrame:
    """Asked with an outcome: the first to ask for a key fetches it and later ones wait for that fetch, failed or not.

    Only the first `most` keys are fetched; whoever asks for another has exhausted the budget.
    """
    first = asked.groupBy(F.col(key).alias("k")).agg(F.min(order).alias("first"))
    taken = first.orderBy("first", "k").limit(most).withColumn("taken", F.lit(True))  # `most` rows
    met = asked.join(first, F.col(key) == F.col("k")).drop("k").join(F.broadcast(taken.select(F.col("k"), "taken")), F.col(key) == F.col("k"), "left")
    outcome = F.when(F.col("taken").isNull(), "ARTICLE_BUDGET_EXHAUSTED").when(F.col(order) == F.col("first"), "fetched").otherwise("waited")
    return met.select(*asked.columns, outcome.alias("outcome"))


def leads(found: DataFrame, query: str, url: str, order: str, per_query: int = 5, queries: int = 12) -> DataFrame:
    """The first hits of the first queries, each url once."""
    few = found.join(F.broadcast(found.select(query).distinct().orderBy(query).limit(queries)), query, "left_semi")  # `queries` rows
    few = top_k(few, query, [F.asc(order)], per_query, rank="__n")
    return few.withColumn("__u", F.row_number().over(Window.partitionBy(url).orderBy(query, order))).where("__u = 1").drop("__n", "__u")
