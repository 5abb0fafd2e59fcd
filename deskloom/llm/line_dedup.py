"""Operator 12: line dedup, by levelled sorted runs of line hashes.

Documents come in batches. A batch's lines become one row for each distinct line key, a hash of 128 bits with the number of
documents that have it. The batch leaves out, by a merge anti-join with the runs, the keys that a run already knows to be
frequent, since more counts tell nothing new about them; the rest is written as a run of its own, bucketed and sorted by hash.
When a level holds FANOUT runs they are merged into one run of the next level, which sums their counts, so a key is rewritten
once a level and the number of runs stays logarithmic. After the last batch the runs are merged a last time; keys of enough
documents are frequent, and all of their lines go.

Runs are tables in the folder that all executors share, with as many buckets as the session has shuffle partitions; joins and
merges of runs read bucket by bucket, so only a batch's own keys are shuffled.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.checkpoints import removed, shared_folder
from deskloom.llm.common import Written, checkpointed, fresh, map_arrow, sized, utf8

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: A text that is more than this part of all rows, of which there are as many at most, goes to so many tasks.
HOT_TEXTS, SALTS = 1_000, 64
BLANKS = " \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What the hash's second half is seeded with, beside the key.
SECOND = "2"


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys(text: Column, least: int) -> Column:
    """The distinct line keys of a text that have `least` code points or more."""
    return F.filter(F.array_distinct(F.transform(F.split(text, "\n", -1), line_key)), lambda k: F.length(k) >= least)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(SECOND), key).alias("b")]


class LineRuns:
    """The levelled runs of the line keys of all batches so far.

    Each add() is a job that can be run anew: a run counts only once its table is whole. Rows are documents: two rows of one
    id are two. An empty batch adds an empty run.
    """

    def __init__(self, spark: SparkSession, documents: int, least: int = 1, fanout: int = FANOUT):
        self.spark, self.documents, self.least, self.fanout = spark, documents, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.folders: dict[str, str] = {}

    def _written(self, counts: DataFrame) -> str:
        """A run of (a, b, n), of which each bucket is one sorted file."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = shared_folder(self.spark, "line-run")
        rows = counts.repartition(self.buckets, "a", "b").sortWithinPartitions("a", "b")
        rows.write.format("parquet").option("path", self.folders[name]).bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(name)
        return name

    def _dropped(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.folders.pop(name))

    def add(self, batch: DataFrame, text: str = "text") -> None:
        each = batch.select(F.explode(keys(utf8(text), self.least)).alias("k")).select(*hashed(F.col("k")))
        counts = each.groupBy("a", "b").agg(F.count("*").alias("n"))
        for run in [r for level in self.levels for r in level]:
            known = self.spark.table(run).where(F.col("n") >= self.documents).select("a", "b")
            counts = counts.join(known.hint("merge"), ["a", "b"], "left_anti")
        self.levels[0].append(self._written(counts))
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._written(self._sum(level)))
                self.levels[i] = []
                for run in level:
                    self._dropped(run)

    def _sum(self, runs: list[str]) -> DataFrame:
        """The runs merged pairwise, bucket by bucket."""
        parts = [self.spark.table(r) for r in runs]
        while len(parts) > 1:
            x, y = parts.pop(0), parts.pop(0).withColumnRenamed("n", "m")
            total = (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
            parts.append(x.hint("merge").join(y, ["a", "b"], "full_outer").select("a", "b", total))
        return parts[0]

    def frequent(self) -> Written:
        """(a, b) of the keys that are found in enough documents, written once."""
        runs = [r for level in self.levels for r in level]
        total = self._sum(runs) if runs else self.spark.createDataFrame([], "a long, b long, n long")
        return Written(total.where(F.col("n") >= self.documents).select("a", "b"))

    def close(self) -> None:
        for name in list(self.folders):
            self._dropped(name)


def _hit(key: bytes, hits: set[tuple[int, int]], seed: int) -> bool:
    import xxhash

    a, b = (xxhash.xxh64_intdigest(key, s) for s in (42, seed))
    return (a - ((a >> 63) << 64), b - ((b >> 63) << 64)) in hits


def without(text: str, hits: set[tuple[int, int]], least: int) -> tuple[str, int, int]:
    """(the lines whose keys are not among hits, how many lines there were, how many went)."""
    import xxhash

    seed = xxhash.xxh64_intdigest(SECOND.encode(), 42)
    lines = text.split("\n")
    kept = []
    for line in lines:
        key = line.strip(BLANKS)
        if len(key) < least or not _hit(key.encode("utf-8", "surrogatepass").translate(_LOWER), hits, seed):
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_frequent_lines(df: DataFrame, frequent: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """df with the columns kept_text, n_lines and n_dropped; frequent has the hashes (a, b) of the keys whose lines go.

    Which keys of a text are frequent is found once for each distinct text, by its hash, and joined to its rows. A text with more
    than one of HOT_TEXTS rows is dealt out over SALTS tasks. Rows keep all their columns.
    """
    p, q, hits, salt = fresh("p"), fresh("q"), fresh("hits"), fresh("salt")
    rows = df.withColumn(p, F.xxhash64(utf8(text))).withColumn(q, F.xxhash64(F.lit(SECOND), utf8(text)))
    each = rows.select(p, q, F.explode(keys(utf8(text), least)).alias("k")).select(p, q, *hashed(F.col("k")))
    met = each.join(sized(frequent), ["a", "b"], "left_semi")
    keyed = met.groupBy(p, q, "a", "b").agg(F.count("*").alias("rows"))  # copies are counted where they are read
    found = checkpointed(keyed.groupBy(p, q).agg(F.collect_list(F.struct("a", "b")).alias(hits), F.max("rows").alias("rows")))  # of one text
    hot = found.where(F.col("rows") > F.lit(df.count() // HOT_TEXTS)).select(p, q, F.lit(SALTS).alias(salt))  # HOT_TEXTS at most
    at_salt = F.coalesce(F.floor(F.rand(7) * F.col(salt)).cast("int"), F.lit(0)).alias(salt)
    dealt = rows.join(F.broadcast(hot), [p, q], "left").select(*[F.col(f"`{c}`") for c in df.columns], p, q, at_salt)
    each_salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salt), F.lit(1)) - 1)).alias(salt)
    texts = found.join(F.broadcast(hot), [p, q], "left").select(p, q, hits, each_salt)
    joined = dealt.join(texts, [p, q, salt], "left").select(*[F.col(f"`{c}`") for c in df.columns], hits)
    schema = df.withColumn("kept_text", F.lit("").cast("string")).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, h in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            x = x or ""
            if h is None:
                out.append((x, x.count("\n") + 1, 0))
            else:
                out.append(without(x, {(y["a"], y["b"]) for y in h}, least))
        kept, n, m = zip(*out, strict=True)
        more = [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[f.name for f in schema])

    return map_arrow(joined, run, schema)


def batches(df: DataFrame, most: int = 8) -> list[DataFrame]:
    """A table of Parquet files as at most so many batches of whole files, each file read once; otherwise the table itself."""
    files = sorted(df.inputFiles())
    n = min(most, len(files))
    return [df.sparkSession.read.schema(df.schema).parquet(*files[i::n]) for i in range(n)] if n > 1 else [df]


def dedup(parts: list[DataFrame], text: str = "text", documents: int = 10, least: int = 1) -> DataFrame:
    """The rows of all parts, in turn batches of documents, with kept_text, n_lines and n_dropped.

    A line goes from every document if its key has `least` code points or more and is found in `documents` rows or more. A
    null or empty text is one empty line; empty keys never go if least is 1 or more. Equal rows each get a row and count
    each; empty tables give an empty table; further columns are carried, whatever their names. Texts are read whole.
    """
    runs = LineRuns(parts[0].sparkSession, documents, least)
    for part in parts:
        runs.add(part, text)
    frequent = runs.frequent().df
    runs.close()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return drop_frequent_lines(whole, frequent, text, least)


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each document."""
    out = dedup(batches(documents.select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT i, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT i, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d)
), f AS (SELECT key FROM l WHERE len(key) >= 1 GROUP BY key HAVING count(DISTINCT i) >= 10),
g AS (
  SELECT i, count(*) AS n_dropped FROM l JOIN f USING (key) GROUP BY i
), r AS (
  SELECT i, string_agg(line, chr(10) ORDER BY k) AS kept FROM l ANTI JOIN f USING (key) GROUP BY i
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (i) LEFT JOIN r USING (i)
"""
