"""Compressed packets of articles (S16): base64 around gzip around JSON, read within stated bounds."""

from __future__ import annotations

import base64
import binascii
import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a packet, its desks and the fields of an article, all of them texts.
MOST_ENCODED, MOST_BODY, ARTICLES, PER_DESK = 48_000, 180_000, 10, 2
DESKS = ["AI & Models", "Work & Tools", "Security & Privacy", "Platforms & Power"]
FIELDS = ["id", "desk", "title", "url", "publisherKey", "sourceText", "sourceSha256", "captureNote"]
TITLE, NOTE, LEAST_SOURCE, MOST_SOURCE, PASSAGES, PASSAGE = 250, 500, 600, 18_000, 128, 6_000

_SHAPE = "OBJECT<" + ", ".join(f"{f}: STRING" for f in sorted(FIELDS)) + ">"


def inflated(encoded: str | None, most: int | None = MOST_BODY) -> str | None:
    """The text in a packet; None unless it is base64 in its one canonical form, whole gzip members, and at most so many octets.

    Inflating stops at the bound, so that a small packet of great contents costs no memory; without one it reads all.
    """
    try:
        data = base64.b64decode(encoded, validate=True)
        if base64.b64encode(data).decode() != encoded or not data:
            return None
        out = b""
        while data:
            member = zlib.decompressobj(zlib.MAX_WBITS | 16)
            out += member.decompress(data, 0 if most is None else most + 1 - len(out))  # 0: all
            if (most is not None and len(out) > most) or not member.eof:
                return None
            data = member.unused_data
        return out.decode("utf-8", "replace")
    except (binascii.Error, zlib.error, TypeError, ValueError):
        return None


def unpacked(encoded: Column, most: int | None = MOST_BODY) -> Column:
    """inflated(), in Arrow batches."""

    def all_inflated(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: inflated(x, most))

    return F.pandas_udf(all_inflated, "string")(encoded)


def packed(body: Column) -> Column:
    """A packet of a text; equal texts give equal packets."""
    return F.pandas_udf(_all_deflated, "string")(body)


def _all_deflated(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else base64.b64encode(gzip.compress(b.encode(), mtime=0)).decode())


def _text(x: Column, most: int) -> Column:
    """A text of some length, trimmed, without control and format characters."""
    return F.length(x).between(1, most) & ~x.rlike(r"(?U)^\s|\s$|[\p{Cc}\p{Cf}]")


def check_packets(packets: DataFrame, publishers: DataFrame, most_encoded: int | None = MOST_ENCODED, most_body: int | None = MOST_BODY) -> DataFrame:
    """(packet, code, articles): why each packet is refused, or null and the number of its articles.

    packets has packet (a key), encoded and sha256; publishers has publisher_key and host, the reviewed ones. A packet decodes within
    its bounds; its text has the digest; it is version 1 with ten articles and nothing else; each article has just its fields, its
    place as id, a desk, a text with its digest, a url of its own at a host of its publisher, and passages of whole lines; each desk
    has two. The first article at fault decides. Nulls are no packet; repeated rows are judged once each if their keys differ. An
    article is some 20,000 characters at most, so a packet is a bounded group. No rows give none. `most_encoded` None reads packets
    of any encoded length, `most_body` None texts of any length, so that what is too long is judged as an article.
    """
    fine = F.col("encoded").rlike(r"^[A-Za-z0-9+/]+={0,2}$") & F.col("sha256").rlike("^[a-f0-9]{64}$")
    if most_encoded is not None:
        fine &= F.length("encoded") <= most_encoded
    fine = F.coalesce(fine, F.lit(False))
    bodies = packets.select("packet", "sha256", fine.alias("fine"), unpacked(F.when(fine, F.col("encoded")), most_body).alias("body"))
    parsed = bodies.select("packet", "sha256", "fine", "body", F.try_parse_json("body").alias("json"))
    parsed = parsed.withColumn("top", F.expr("try_variant_get(json, '$', 'map<string, variant>')")).withColumn("articles", F.expr("try_variant_get(json, '$.articles', 'array<variant>')"))
    shape = F.array_sort(F.map_keys("top")) == F.array(F.lit("articles"), F.lit("version"))
    number = F.schema_of_variant(F.col("top")["version"]).rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
    shape &= number & F.expr("try_variant_get(json, '$.version', 'double') = 1") & (F.size("articles") == ARTICLES)
    early = (
        F.when(~F.col("fine") | F.col("json").isNull(), "BENCHMARK_PACKET").when(F.sha2("body", 256) != F.col("sha256"), "BENCHMARK_PACKET_HASH")
        .when(~F.coalesce(shape, F.lit(False)), "BENCHMARK_PACKET")
    )
    judged = parsed.select("packet", early.alias("early"), F.when(early.isNull(), F.col("articles")).alias("articles"))

    urls = F.transform("articles", lambda a: F.try_variant_get(a, "$.url", "string"))
    rows = judged.select("packet", "early", urls.alias("urls"), F.posexplode_outer("articles").alias("pos", "a"))
    rows = rows.select("packet", "early", "urls", "pos", (F.schema_of_variant("a") == _SHAPE).alias("whole"), *[F.expr(f"try_variant_get(a, '$.{f}', 'string')").alias(f) for f in FIELDS])
    host = F.lower(F.regexp_extract("url", r"^https://([^/?#@:]+)(?:/[^#\s]*)?$", 1))
    reviewed = publishers.select(F.col("publisher_key").alias("publisherKey"), F.lower("host").alias("host")).distinct().withColumn("reviewed", F.lit(True))
    rows = rows.withColumn("host", host).join(reviewed, ["publisherKey", "host"], "left")
    lines = F.split("sourceText", "\n")
    article = F.col("whole") & (F.col("id") == F.format_string("A%02d", F.col("pos") + 1)) & F.col("desk").isin(DESKS) & _text(F.col("title"), TITLE) & _text(F.col("captureNote"), NOTE)
    article &= F.length("sourceText").between(LEAST_SOURCE, MOST_SOURCE) & (F.sha2("sourceText", 256) == F.col("sourceSha256"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(~holds(article), "BENCHMARK_ARTICLE").when(~holds(F.col("reviewed") & (F.array_position("urls", F.col("url")) == F.col("pos") + 1)), "BENCHMARK_SOURCE")
        .when(~holds((F.size(lines) <= PASSAGES) & F.forall(lines, lambda x: _text(x, PASSAGE))), "BENCHMARK_PASSAGES")
    )
    rows = rows.withColumn("code", code)
    desks = [F.count_if(F.col("desk") == desk) for desk in DESKS]
    thin = desks[0] < PER_DESK
    for n in desks[1:]:
        thin |= n < PER_DESK
    late = F.coalesce(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("pos"))), F.when(thin, F.lit("BENCHMARK_COVERAGE")))
    out = rows.groupBy("packet").agg(F.coalesce(F.first("early"), late).alias("code"))
    return out.withColumn("articles", F.when(F.col("code").isNull(), ARTICLES).otherwise(0))
