"""Operator 6: token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts that have not been met yet are held as one ragged array of symbol ids. Each round
looks up the rank of every adjacent pair at once, takes the lowest rank of each sequence, and applies that pair at all its
places in that sequence; sequences without a known pair are done. What is left of a sequence is its number of tokens.
Counts of short pre-tokens are memoised by the worker, so that most of a text is a table look-up.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.bpe import default_pattern, parts
from deskloom.llm.common import map_arrow, utf8

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
MEMO_CHARS, MEMO_ENTRIES = 40, 400_000
#: Symbols that are merged at a time.
BLOCK_SYMBOLS = 1 << 20
NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next unused from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens by the merges of one byte-level vocabulary file."""

    def __init__(self, model: dict, pattern: str):
        import regex

        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        if model["pre_tokenizer"].get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without a prefix space is needed")
        letters = byte_letters()
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in model.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, int] = {}

    def pair_ranks(self, symbols: np.ndarray) -> np.ndarray:
        key = symbols[:-1] << 20 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word, all merged in step."""
        lengths = np.array([len(w) for w in words], np.int64)
        counts = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        live = np.flatnonzero(lengths > 1)
        keep = np.repeat(lengths > 1, lengths)
        symbols, sequence = symbols[keep], np.repeat(np.arange(len(live)), lengths[live])
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1] = self.pair_ranks(symbols)
            last = np.append(sequence[1:] != sequence[:-1], True)
            rank[last] = NONE
            starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            sizes = np.diff(np.append(starts, len(symbols)))
            counts[live[done]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
            if np.any(hit[1:] & hit[:-1]):  # a pair of equal symbols: of a run, every second place from its left end
                where = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), where, 0))
                hit &= (where - begin) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.result[rank[at]]
            stay = np.repeat(~done, sizes)
            stay[at + 1] = False
            symbols = symbols[stay]
            sequence = (np.cumsum(~done) - 1)[sequence[stay]]
            live = live[~done]
        return counts

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of words that are not in the memo; short ones go there."""
        out: dict[str, int] = {}
        block: list[str] = []
        size = 0
        for i, word in enumerate(words):
            block.append(word)
            size += len(word)
            if size >= BLOCK_SYMBOLS or i == len(words) - 1:
                out.update(zip(block, self.merge([w.encode("utf-8") for w in block]).tolist(), strict=True))
                block, size = [], 0
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo.update((w, n) for w, n in out.items() if len(w) <= MEMO_CHARS)
        return out

    def plain(self, text: str) -> int:
        total = 0
        for part in parts(text):
            words = self.find(part)
            found = list(map(self.memo.get, words))
            if None in found:
                new = self.learn(list(dict.fromkeys(w for w, n in zip(words, found, strict=True) if n is None)))
                found = [new[w] if n is None else n for w, n in zip(words, found, strict=True)]
            total += sum(found)
        return total

    def count(self, text: str) -> int:
        """The tokens of text; each special string in it is one."""
        if self.special is None or not (found := len(self.special.findall(text))):
            return self.plain(text)
        return found + sum(map(self.plain, self.special.split(text)))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    with open(path, encoding="utf-8") as file:
        return Counter(json.load(file), pattern)


def counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each whole text; null counts as the empty text, which has no tokens.

    One row for each row, repeats and rows without a key included; texts of any length are counted whole; an empty table gives
    an empty table; other columns, whatever their names, are not carried.
    """
    path, pattern = path or default_path(), default_pattern()
    rows = df.select(F.col(key), utf8(text).alias("__text"))
    schema = rows.select(key, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(path, pattern)
        n = [own.count(x) for x in batch.column(1).to_pylist()]
        size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return map_arrow(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
