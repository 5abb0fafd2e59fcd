"""Operator 5: license scans, in DataFrame expressions only.

Rules are regular expressions over words. A text without any keyword of a rule is only counted. In others, each place of a
keyword is tried with the rules whose rarest literal word stands where that rule wants it, which are a few of all; so a
detection's interval of words is known at once. A detection is suppressed if its interval lies within one of a rule of a
higher level, or strictly within one of its own level; an interval that holds another begins within LONGEST words of it, so
only the neighbouring places are looked at. All of it happens within a row: nothing is shuffled, and a text costs time in
proportion to its length, however many detections it has.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.license_rules import BASE_CONFIDENCE, CONFIDENCE, LONGEST, Rule, rules

#: What parts words: everything in ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LITERAL = re.compile(r"[a-z0-9]+")


def literals(rule: Rule) -> list[tuple[int, str]]:
    """The words that every match of a rule has at a fixed distance from its keyword, the keyword itself included."""
    words = rule.pattern.removeprefix("^").removesuffix("(?= |$)").split(" ")
    out = [(i - rule.before, w) for i, w in enumerate(words[: rule.before + 1]) if _LITERAL.fullmatch(w)]
    for i, w in enumerate(words[rule.before + 1 :], 1):
        if not _LITERAL.fullmatch(w):
            break
        out.append((i, w))
    return out or [(0, rule.keyword)]


def by_literal(known: list[Rule]) -> dict[tuple[str, int, str], list[Rule]]:
    """Rules by keyword, distance and word: each under the one of its literals that fewest rules of its keyword have."""
    shared = Counter((r.keyword, *x) for r in known for x in literals(r))
    out: dict[tuple[str, int, str], list[Rule]] = defaultdict(list)
    for r in known:
        distance, word = min(literals(r), key=lambda x: (shared[(r.keyword, *x)], abs(x[0]), x))
        out[r.keyword, distance, word].append(r)
    return out


def _tables(known: list[Rule]) -> tuple[Column, Column]:
    """Keyword -> the distances at which its rules' literals stand; and "keyword distance word" -> rules."""
    grouped = by_literal(known)
    distances: dict[str, set[int]] = defaultdict(set)
    for keyword, distance, _ in grouped:
        distances[keyword].add(distance)
    of_literal = {" ".join(map(str, k)): [r._asdict() for r in rs] for k, rs in grouped.items()}
    at = {k: sorted(v) for k, v in distances.items()}
    # as one constant each, which the optimizer reads once; built of thousands of literals, planning would take seconds
    return (
        F.from_json(F.lit(json.dumps(at)), "map<string, array<int>>"),
        F.from_json(F.lit(json.dumps(of_literal)), "map<string, array<struct<label: string, level: int, before: int, pattern: string, base: boolean>>>"),
    )


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, detections, kept): each whole text's detections (start, size, label, level, base) in order of place.

    kept are those that are base or not suppressed. A null text is empty. Rows, repeats included, each get a row; an empty
    table gives an empty table.
    """
    known = rules()
    keywords = sorted({r.keyword for r in known})
    reach = LONGEST + max(r.before for r in known)  # words, and so places, between the keywords of two detections of which one holds the other
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    split = df.select(F.col(key), F.split(low, GAP).alias("p"))
    first, last = (F.element_at("p", F.lit(i)) == "" for i in (1, -1))
    lone = F.size("p") == 1
    cut = F.when(lone, F.when(first, F.slice("p", 1, 0)).otherwise(F.col("p"))).otherwise(
        F.slice(F.col("p"), F.when(first, 2).otherwise(1), F.size("p") - first.cast("int") - last.cast("int"))
    )
    rows = split.select(key, cut.alias("words"))
    hit = F.from_json(F.lit(json.dumps(keywords)), "array<string>")
    gate = F.arrays_overlap("words", hit)
    rows = rows.select(key, F.size("words").cast("long").alias("n_words"), F.when(gate, F.col("words")).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when(F.array_contains(hit, w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    distances, of_literal = _tables(known)
    rows = rows.withColumn("places", F.when(F.col("w").isNotNull(), places)).withColumn("distances", distances).withColumn("rules", of_literal)

    def tried(place: Column) -> Column:
        def near(distance: Column) -> Column:
            word = F.get(F.col("w"), place["i"] + distance)
            return F.coalesce(F.element_at(F.col("rules"), F.concat_ws(" ", place["w"], distance.cast("string"), word)), F.expr("array()"))

        def one(rule: Column) -> Column:
            start = place["i"] - rule["before"]
            found = F.call_function("regexp_extract", F.array_join(F.slice(F.col("w"), F.greatest(start + 1, F.lit(1)), LONGEST), " "), rule["pattern"], F.lit(0))
            size = F.when((start < 0) | (found == ""), 0).otherwise(F.length(found) - F.length(F.replace(found, F.lit(" "))) + 1)
            return F.struct(start.cast("long").alias("start"), size.cast("long").alias("size"), rule["label"].alias("label"), rule["level"].alias("level"), rule["base"].alias("base"))

        rules_here = F.flatten(F.transform(F.element_at(F.col("distances"), place["w"]), near))
        return F.filter(F.transform(rules_here, one), lambda d: d["size"] > 0)

    none = F.expr("cast(array() as array<array<struct<start:bigint,size:bigint,label:string,level:int,base:boolean>>>)")
    rows = rows.select(key, "n_words", F.coalesce(F.transform("places", tried), none).alias("found"))

    def holds(outer: Column, inner: Column) -> Column:
        over = (outer["start"] <= inner["start"]) & (outer["start"] + outer["size"] >= inner["start"] + inner["size"])
        return over & ((outer["level"] < inner["level"]) | ((outer["level"] == inner["level"]) & (outer["size"] > inner["size"])))

    def standing(own: Column, place: Column) -> Column:
        around = F.slice(F.col("found"), F.greatest(place + 1 - reach, F.lit(1)), 2 * reach + 1)
        return F.filter(own, lambda d: d["base"] | ~F.exists(around, lambda near: F.exists(near, lambda o: holds(o, d))))

    ordered = lambda found: F.array_sort(F.flatten(found))
    return rows.select(key, "n_words", ordered(F.col("found")).alias("detections"), ordered(F.transform("found", standing)).alias("kept"))


def licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (null without
    any). Labels are distinct, sorted and joined by commas, empty if there are none; score is the surest detection's
    confidence, 0 without any. Null texts are empty, texts of any length are read whole; repeated rows each get a row; an empty
    table gives an empty table; extra columns are not carried.
    """
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    levels = F.array(*[F.lit(c) for c in CONFIDENCE])
    sure = F.transform("kept", lambda d: F.when(d["base"], F.lit(BASE_CONFIDENCE)).otherwise(F.element_at(levels, d["level"] + 1)))
    return scan(df, key, text).select(
        key, "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )
