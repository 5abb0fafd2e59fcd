"""The repeat ledger: idempotent append, retention, migration, keyed digests, signed tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.text import base64url, hmac_sha256


def derived_key(key: bytes, domain: str) -> bytes:
    """A key of its own for each domain."""
    import hashlib
    import hmac

    if len(key) < 32:
        raise ValueError("a key of 32 bytes or more is needed")
    return hmac.new(key, f"{domain}\0key".encode(), hashlib.sha256).digest()


def fingerprint(key: bytes, label: str, value: Column, domain: str = "ledger:v2") -> Column:
    """A digest of a value, separate for each label."""
    return hmac_sha256(derived_key(key, domain), F.concat(F.lit(f"{domain}:{label}\0"), value))


def fingerprints(key: bytes, label: str, values: Column, domain: str = "ledger:v2") -> Column:
    """X01 for arrays: sorted digests."""
    return F.array_sort(F.transform(values, lambda v: fingerprint(key, label, v, domain)))


def append(ledger: DataFrame, new: DataFrame, date: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ledger with new rows, conflicts): equal rows of a known date change nothing; different or older ones conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    known = ledger.groupBy(F.col(date).alias("d")).agg(F.array_sort(F.collect_set(digest)).alias("h"))
    given = new.groupBy(F.col(date).alias("d")).agg(F.array_sort(F.collect_set(digest)).alias("g"))
    latest = ledger.agg(F.max(date).alias("latest"))
    judged = given.join(known, "d", "left").crossJoin(F.broadcast(latest))  # one row
    verdict = F.when(F.col("h").isNotNull(), F.when(F.col("h") == F.col("g"), "same").otherwise("different")).when(F.col("d") < F.col("latest"), "older").otherwise("new")
    judged = judged.select("d", verdict.alias("verdict"))
    fresh = new.join(judged.where("verdict = 'new'"), F.col(date) == F.col("d"), "left_semi")
    return ledger.unionByName(fresh), judged.where("verdict IN ('different', 'older')")


def prune(ledger: DataFrame, date: str, as_of: str, editions: int = V.MAX_EDITIONS, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Rows of the last `days` days up to as_of, of the latest `editions` dates."""
    kept = ledger.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))
    dates = kept.select(F.col(date).alias("d")).distinct().orderBy(F.desc("d")).limit(editions)
    return kept.join(F.broadcast(dates), F.col(date) == F.col("d"), "left_semi")  # `editions` rows


def state_issues(stories: DataFrame, date: str, event: str, desk: str) -> DataFrame:
    """(date, code) for what a ledger must not hold; the date is null for what concerns all of it."""
    per = stories.groupBy(F.col(date).alias("date")).agg(F.count("*").alias("n"), F.count_distinct(event).alias("events"), F.count_distinct(desk).alias("desks"))
    own = F.array_compact(
        F.array(
            F.when(F.col("n") > V.MAX_STORIES_PER_EDITION, F.lit("TOO_MANY_STORIES_IN_EDITION")),
            F.when(F.col("events") < F.col("n"), F.lit("REPEATED_EVENT")), F.when(F.col("desks") < F.col("n"), F.lit("REPEATED_DESK")),
        )
    )
    whole = per.agg(F.count("*").alias("editions"), F.coalesce(F.sum("n"), F.lit(0)).alias("stories")).select(
        F.lit(None).cast(dict(stories.dtypes)[date]).alias("date"),
        F.explode(F.array_compact(F.array(F.when(F.col("editions") > V.MAX_EDITIONS, F.lit("TOO_MANY_EDITIONS")), F.when(F.col("stories") > V.MAX_STORIES, F.lit("TOO_MANY_STORIES"))))).alias("code"),
    )
    return per.select("date", F.explode(own).alias("code")).unionByName(whole)


def migrated(versions: DataFrame, version: str, count: str) -> DataFrame:
    """Rows of the current version as they are, older ones with their count only."""
    current = F.col(version) == 2
    return versions.select(F.lit(2).alias("schema_version"), F.col(count).alias("recorded"), current.alias("keeps_rows"))


def first_write(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """X05/S14 in batch: the first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def insert_new(target: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of new whose key target lacks, one for each key."""
    return first_write(new, key, order).join(target.select(key), key, "left_anti")


def mint_token(key: bytes, payload: Column) -> Column:
    """Payload and signature, both base64url, joined by a dot."""
    body = base64url(F.encode(payload, "utf-8"))
    return F.concat(body, F.lit("."), base64url(F.unhex(hmac_sha256(key, body))))


def token_state(key: bytes, token: Column, now: Column, longest_days: int = 14, skew_seconds: int = 300) -> Column:
    """Malformed, forged, expired, too-long or valid; the payload is JSON with iat and exp in seconds."""
    body, signature = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    plain = F.translate(body, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    text = F.decode(F.call_function("try_to_binary", padded, F.lit("base64")), "utf-8")
    issued, expires = F.get_json_object(text, "$.iat").try_cast("long"), F.get_json_object(text, "$.exp").try_cast("long")
    return (
        F.when(~F.coalesce(token.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{43}$"), F.lit(False)), "malformed")
        .when(base64url(F.unhex(hmac_sha256(key, body))) != signature, "forged")
        .when(issued.isNull() | expires.isNull(), "malformed")
        .when(expires - issued > longest_days * 86400 + skew_seconds, "too-long")
        .when(now > expires + skew_seconds, "expired")
        .otherwise("valid")
    )
