"""A corpus pipeline of four stages over `documents`, each by one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and gives it to the
next one. A stage sets the session's Arrow batches to a few MB, as suits executors with little memory beside the heap. All
but the last return the columns of docs, whatever their names. In every stage a null or empty text is a
document like others, texts of any length are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.checkpoints import removed, shared_folder
from deskloom.llm import bpe, mixing, simhash, toxicity
from deskloom.llm.common import fresh, small_batches, table


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; labels come from the table, never from a document itself.

    Every row is judged by its text alone, so repeated rows stay or go together, with or without a doc_id.
    """
    small_batches(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh("score")
    return _columns(toxicity.scored(docs, lexicon, out=score).where(F.col(score) < 0.5), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest doc_id, nulls last; of its copies, one.

    Rows that share a doc_id but do not link are of different groups and stay each.
    """
    small_batches(spark)
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or more: sources in the mixture's weights, the least repeated one passed over once.

    Equal rows, and rows without a doc_id or source, are documents of their own.
    """
    small_batches(spark)
    return _columns(mixing.mix(docs, prefix=fresh("mix")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, token_ids, n_tokens, round_trip): each row's ids, packed, their number, and whether they
    decode to its text. A null text has no ids. One row for each row, repeats and those without a doc_id included.
    """
    small_batches(spark)
    ids, decoded = fresh("ids"), fresh("decoded")
    whole = bpe.recode(docs, ids=ids, decoded=decoded)
    return whole.select(
        "doc_id", "lang", "source", F.col(ids).alias("token_ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        (F.col(decoded) == F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: A learnt lexicon and merges by rank are not expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            removed(spark, before)
        before = folder
    return docs
