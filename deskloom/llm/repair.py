"""Operator 11: repair of the structure of conversations, by a fold of Spark's higher-order functions.

Window functions put a conversation's turns in order and flag the first fault of each. The turns are then collected as sorted
small structs (a role's initial and the flags, no text), and aggregate() folds them through an automaton of four states:
nothing yet, after a system turn, after a user's, after an assistant's. Each state carries one struct (cost, audit), the
cheapest edits that lead there with the letters of the edits; least() of the structs that reach a state picks the cheapest,
and of these the least letters. Of two audits of one cost for the same turns neither begins the other, since a letter's cost
is the same in both, so what is least before a turn stays least after it, and the fold finds the least of all.

A fold takes at most CHUNK turns. Those of a longer conversation's later chunks begin in each of the four states, and folds of
chunks, FOLD at a time, join them, so no task holds a conversation and letters are copied in proportion to a chunk. What the
edits make of the turns is streamed in order, a turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deskloom.llm.common import Written, slices

CHUNK, FOLD = 512, 16
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: More than any edits cost: a state that cannot be reached.
FAR = 1 << 60
STATES = [f"s{i}" for i in range(4)]
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ["blank", "duplicate", "truncated"]


def faults(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, place, initial, fault, illegal) for each row of df, by turn, then role and text; nulls first.

    fault is the first of blank, duplicate and truncated that the turn has, else null; illegal says whether the turn and the
    one before are no pair that may follow each other. Null roles and texts are one space.
    """
    rows = df.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    ended = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1).withColumn("initial", initial)
        .withColumn("illegal", ~F.concat(F.lag("initial").over(inside), "initial").isin("su", "ua", "au"))
        .withColumn("again", F.row_number().over(alike) > 1)
        .withColumn("fault", F.when(ended == "", "blank").when(F.col("again"), "duplicate").when(~ended.isin(".", "!", "?"), "truncated"))
        .drop("again")
    )


def _edit(best: Column, letter: str, more: Column | int = 0) -> Column:
    """best with one more edit."""
    return F.struct((best["cost"] + COSTS[letter] + more).alias("cost"), F.concat(best["audit"], F.lit(letter)).alias("audit"))


def _inserted(s: list[Column]) -> list[Column]:
    """The states after as many insertions as pay: a user's turn, an assistant's, or both; more would come back at a cost."""
    user = F.least(s[USER], *[_edit(s[i], INSERT) for i in (NONE, SYSTEM, ASSISTANT)])
    return [s[NONE], s[SYSTEM], user, F.least(s[ASSISTANT], _edit(user, INSERT))]


def _after(s: list[Column], turn: Column) -> list[Column]:
    """The states after a turn, before insertions."""
    gone = [_edit(x, DELETE) for x in s]
    must = turn["must_go"]
    late = F.when(turn["truncated"], TRUNCATED_COST).otherwise(0)
    never = F.struct(F.lit(FAR).alias("cost"), F.lit("").alias("audit"))

    def entered(state: int, letter: str, sources: list[int]) -> Column:
        stays = [_edit(s[i], REROLE, late) for i in sources] if state in ROLES else []
        stays += [F.when(turn["initial"] == letter, _edit(s[i], KEEP, late)).otherwise(never) for i in sources]
        return F.when(must, gone[state]).otherwise(F.least(gone[state], *stays))

    return [
        gone[NONE], entered(SYSTEM, "s", [NONE]), entered(USER, "u", [NONE, SYSTEM, ASSISTANT]), entered(ASSISTANT, "a", [USER]),
    ]


def _states(s: list[Column]) -> Column:
    return F.struct(*[x.alias(n) for x, n in zip(s, STATES, strict=True)])


def _begun(state: Column) -> list[Column]:
    return [F.struct(F.when(state == i, 0).otherwise(FAR).cast("long").alias("cost"), F.lit("").alias("audit")) for i in range(4)]


def _folded(turns: Column, state: Column, first: Column) -> Column:
    """The states after turns that are met in `state`; a conversation's first turns may have insertions before them."""

    def step(held: Column, turn: Column) -> Column:
        # one level of nesting for the states after the turn, so that insertions refer to them by name
        after = F.array(_states(_after([held[n] for n in STATES], turn)))
        return F.transform(after, lambda x: _states(_inserted([x[n] for n in STATES])))[0]

    begun = _begun(state)
    start = F.when(first, _states(_inserted(begun))).otherwise(_states(begun))
    return F.aggregate(turns, start, step)


def _chained(pieces: Column) -> Column:
    """Chunks in order as one: for each state that the first one begins in, the states after the last one."""

    def step(held: Column, piece: Column) -> Column:
        ways = [
            F.least(*[F.struct((held[m]["cost"] + piece["to"][i][n]["cost"]).alias("cost"), F.concat(held[m]["audit"], piece["to"][i][n]["audit"]).alias("audit")) for i, m in enumerate(STATES)])
            for n in STATES
        ]
        return _states(ways)

    rest = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    return F.transform(pieces[0]["to"], lambda begun: F.aggregate(rest, begun, step))


def audits(flagged: DataFrame) -> DataFrame:
    """(conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations of faults().

    gaps are the turns that no row has between the least and the greatest.
    """
    turn = F.struct("place", "initial", F.col("fault").isin("blank", "duplicate").alias("must"), (F.col("fault") == "truncated").alias("late"))
    one = lambda x: F.struct(x["initial"].alias("initial"), F.coalesce(x["must"], F.lit(False)).alias("must_go"), F.coalesce(x["late"], F.lit(False)).alias("truncated"))
    counted = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    chunks = flagged.groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(turn)), one).alias("turns"), F.count("*").alias("n"),
        *[counted(F.coalesce(F.col("fault") == f, F.lit(False)))(f) for f in FAULTS], counted(F.coalesce("illegal", F.lit(False)))("illegal"),
    )
    counts = ["n", *FAULTS, "illegal"]
    begins = F.when(F.col("chunk") == 0, F.array(F.lit(NONE))).otherwise(F.array(*[F.lit(i) for i in range(4)]))
    pieces = chunks.select("conv_id", "chunk", *counts, F.transform(begins, lambda s: _folded(F.col("turns"), s, F.col("chunk") == 0)).alias("to"))
    held = Written(pieces)
    while (last := held.df.agg(F.max("chunk")).first()[0]) is not None and last > 0:
        joined = held.df.groupBy("conv_id", F.floor(F.col("chunk") / FOLD).alias("chunk")).agg(
            *[F.sum(c).alias(c) for c in counts], F.array_sort(F.collect_list(F.struct("chunk", "to"))).alias("pieces")
        )
        more = Written(joined.select("conv_id", "chunk", *counts, _chained(F.col("pieces")).alias("to")))
        held.remove()
        held = more
    best = F.least(F.col("to")[0][STATES[NONE]], F.col("to")[0][STATES[ASSISTANT]])
    gaps = flagged.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = held.df.select("conv_id", F.col("n").alias("turns"), *FAULTS, "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))
    known = gaps.withColumnRenamed("conv_id", "known")
    return out.join(known, out["conv_id"].eqNullSafe(known["known"])).drop("known")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of the turns that each audit leaves or inserts, and a row without a role at the end of
    each conversation with its facts in place of the text.

    batches are (conv_id, place, role, text, audit and facts) by conversation and place; the row at place -1 has the audit.
    Holds one turn, a slice of rows and the audit.
    """
    conversation, audit, at, out, state, facts = None, "", 0, 0, NONE, None

    def inserted():
        """The insertions before the next edit that takes a row."""
        nonlocal at, out, state
        while at < len(audit) and audit[at] == INSERT:
            state = ASSISTANT if state == USER else USER
            yield conversation, out, ROLES[state], "", INSERT
            at, out = at + 1, out + 1

    for batch in batches:
        for part in slices(batch):
            for conv, place, role, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if place < 0:
                    if facts is not None:
                        yield from inserted()
                        yield conversation, out, None, facts, None
                    conversation, audit, at, out, state, facts = conv, found["audit"] or "", 0, 0, NONE, found
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit != DELETE:
                    if edit == KEEP:
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                    else:
                        state = ASSISTANT if state == USER else USER
                        role = ROLES[state]
                    yield conversation, out, role, text, edit
                    out += 1
    if facts is not None:
        yield from inserted()
        yield conversation, out, None, facts, None


FACTS = ["gaps", *FAULTS, "illegal", "cost", "audit"]


def _streamed(flagged: DataFrame, originals: DataFrame) -> DataFrame:
    """The rows that edited() reads: each conversation's turns behind a row of its facts, sorted within their partitions."""
    known = audits(flagged).withColumnRenamed("conv_id", "known")
    heads = originals.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("known")), "left").select(
        "conv_id", F.lit(-1).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.struct(*[F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in FACTS]).alias("facts"),
    )
    turns = flagged.select("conv_id", "place", "role", "text", F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"))
    return heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(flagged: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, in order by place."""
    schema = StructType.fromDDL(f"conv_id {dict(flagged.dtypes)['conv_id']}, place long, role string, text string, edit string")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in edited(batches):
            if row[2] is not None:
                held.append(row)
                size += len(row[3])
            if len(held) >= 10_000 or size > 1 << 20:
                yield _packed(held, kinds)
                held, size = [], 0
        yield _packed(held, kinds)

    return _streamed(flagged, originals).mapInArrow(run, schema)


def _packed(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)


def digests(flagged: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of originals.

    flagged are the faults() of the rows to repair; a conversation without any has zeros, an empty audit and the digest of the
    empty text. Rows without a conv_id are one conversation; rows that repeat others are turns of their own; texts are read
    whole; an empty table gives an empty table; extra columns are not carried.
    """
    facts = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in FACTS)
    schema = StructType.fromDDL(f"conv_id {dict(flagged.dtypes)['conv_id']}, {facts}, repaired_sha256 string")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, digest = [], 0, hashlib.sha256()
        for conv, place, role, text, _ in edited(batches):
            if role is not None:
                digest.update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                continue
            done.append((conv, *[text[c] for c in FACTS], digest.hexdigest()))
            size, digest = size + len(text["audit"]), hashlib.sha256()
            if len(done) >= 1_000 or size > 1 << 20:
                yield _packed(done, kinds)
                done, size = [], 0
        yield _packed(done, kinds)

    return _streamed(flagged, originals).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of conv_id:turn; a null there, or as a role or text, is one space."""
    blank = F.lit(" ")
    rows = df.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    times = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(code != 0).select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The digests of conversations that damaged() has damaged."""
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(faults(damaged(own)), own)


SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), bits AS (
  SELECT b, list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS g(b)
), crcs AS (SELECT list(t ORDER BY b) AS ts FROM bits),
keyed AS (
  SELECT k, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, x: xor(c >> 8, ts[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS code FROM (SELECT DISTINCT k FROM r), crcs
), d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again FROM r JOIN keyed USING (k) WHERE code <> 0
), f AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER w AS place,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS dup FROM f
), t AS (
  SELECT *, body = '' AS blank, body <> '' AND dup AS duplicate, body <> '' AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS late FROM g
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE late) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM t GROUP BY conv_id
), fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place,
    [{c: CAST(0 AS BIGINT), a: '', x: CAST([] AS VARCHAR[])}, {c: 1000000000, a: '', x: []}, {c: 2, a: 'I', x: ['user:']}, {c: 4, a: 'II', x: ['user:', 'assistant:']}] AS s
  FROM facts
  UNION ALL
  SELECT conv_id, place, [s[1], s[2], u, list_min([s[4], {c: u.c + 2, a: u.a || 'I', x: u.x || ['assistant:']}])] AS s FROM (
    SELECT conv_id, place, s, list_min([s[3]] || list_transform([s[1], s[2], s[4]], lambda y: {c: y.c + 2, a: y.a || 'I', x: y.x || ['user:']})) AS u FROM (
      SELECT t.conv_id, t.place, list_transform([1, 2, 3, 4], lambda q: list_min(
        [{c: s[q].c + 3, a: s[q].a || 'D', x: s[q].x}]
        || CASE WHEN blank OR duplicate OR q < 3 THEN [] ELSE list_transform(CASE q WHEN 3 THEN [s[1], s[2], s[4]] ELSE [s[3]] END,
          lambda y: {c: y.c + 2 + CAST(late AS BIGINT), a: y.a || 'R', x: y.x || [CASE q WHEN 3 THEN 'user:' ELSE 'assistant:' END || text]}) END
        || CASE WHEN blank OR duplicate OR q = 1 OR i <> ['', 's', 'u', 'a'][q] THEN [] ELSE list_transform(CASE q WHEN 2 THEN [s[1]] WHEN 3 THEN [s[1], s[2], s[4]] ELSE [s[3]] END,
          lambda y: {c: y.c + CAST(late AS BIGINT), a: y.a || 'K', x: y.x || [role || ':' || text]}) END)) AS s
      FROM fold JOIN t ON t.conv_id IS NOT DISTINCT FROM fold.conv_id AND t.place = fold.place + 1
    )
  )
), best AS (
  SELECT conv_id, list_min([s[1], s[4]]) AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS n FROM fold) WHERE n = 1
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.x, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
