"""Operator 4: byte-level BPE encoding and decoding.

A pre-token's bytes are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds, in one
pass, the longest token that starts at each position. From these, the encoder backtracks: it takes the longest token
whose pair with the token before is one that the merges would leave side by side, else the next shorter one, else it
gives up the token before and marks that position as a dead end. Each position is given up at most once, so the time is
linear in the length, and the ids equal those of the merges by rank. Whether two tokens may stand side by side is
memoised; so are whole short pre-tokens.

Ids travel as binary columns of little-endian unsigned 32-bit integers: compact, and bounded by the text's own size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import fresh, map_arrow, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of more characters are not memoised; the memos start anew when they hold this many entries.
MEMO_CHARS, MEMO_ENTRIES = 40, 300_000
#: Long texts are split into parts of about this many characters, where the pattern splits them anyway.
PART_CHARS = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parts(text: str) -> Iterator[str]:
    """Parts of text that the pattern never spans: each but the first begins with a lone space between two words."""
    start, n = 0, len(text)
    while n - start > PART_CHARS:
        at = start + PART_CHARS
        while 0 < (at := text.find(" ", at)) < n - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at += 1
        if not 0 < at < n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Codec:
    """Encoder and decoder for one rank file; one of each is held by a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[int, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids by repeated merging of the lowest-ranked pair; for short pieces."""
        if piece in self.ranks and len(piece) == 1:
            return [self.ranks[piece]]
        part = [piece[i : i + 1] for i in range(len(piece))]
        while len(part) > 1:
            best = min(range(len(part) - 1), key=lambda i: self.ranks.get(part[i] + part[i + 1], 1 << 60))
            if (pair := part[best] + part[best + 1]) not in self.ranks:
                break
            part[best : best + 2] = [pair]
        return [self.ranks[p] for p in part]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when they stand side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for single bytes."""
        known = self.prefixes.get(token)
        if known is None:
            text = self.tokens[token]
            known = next((r for n in range(len(text) - 1, 0, -1) if (r := self.ranks.get(text[:n])) is not None), -1)
            self.prefixes[token] = known
        return known

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, tokens = len(piece), self.tokens
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # later ends are longer tokens
            longest[end + 1 - len(tokens[token])] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:  # nothing fits here: the token before was too long
                if before < 0:
                    raise ValueError("the vocabulary cannot spell this text")
                dead[at] = 1
                out.pop()
                at -= len(tokens[before])
                token = before

    def learn(self, word: str) -> bytes:
        packed = np.array(self.piece(word.encode("utf-8")), "<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of text, packed."""
        out: list[bytes] = []
        for part in parts(text):
            words = self.find(part)
            found = list(map(self.memo.get, words))
            if None in found:
                found = [self.memo.get(w) or self.learn(w) if f is None else f for w, f in zip(words, found, strict=True)]
            out.append(b"".join(found))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode(
    df: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """df with one more binary column: the ids of each whole text (null: empty), 4 bytes each.

    Rows, their repeats and all other columns stay; a column that is already named as `out` is replaced.
    An empty text has no ids. An empty table gives an empty table.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    return _with(df, text, [out], "string", lambda x: (codec(path, pattern).encode(x),), "")


def recode(
    df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """df with encode()'s column and decode()'s of it, made in one Python pass."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def both(x: str) -> tuple[bytes, bytes]:
        own = codec(path, pattern)
        packed = own.encode(x)
        return packed, own.decode(packed)

    return _with(df, text, [ids, decoded], "string", both, "")


def decode(
    df: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """df with one more binary column: the bytes that packed ids (null: none) stand for."""
    path, pattern = path or default_path(), pattern or default_pattern()
    return _with(df, ids, [out], "binary", lambda x: (codec(path, pattern).decode(x),), b"")


def _with(df: DataFrame, read: str, out: list[str], kind: str, convert, empty) -> DataFrame:
    """df with binary columns named as in out: what convert makes of each value of a column, nulls as empty."""
    kept = [c for c in df.columns if c not in out]
    given = fresh("given")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{read}`").cast(kind).alias(given))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(b"").alias(o) for o in out]).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [convert(empty if x is None else x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], *[pa.array(v, pa.binary()) for v in zip(*values, strict=True)]]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *out])

    return map_arrow(rows, run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, token_ids, decoded): each text's packed ids, and the bytes that those ids decode to, in one Python pass.

    A null text is empty and has no ids; texts of any length are read whole. Rows that repeat others, or lack a key, each get
    a row; an empty table gives an empty table; other columns, whatever their names, are not carried.
    """
    path, pattern = path or default_path(), default_pattern()
    rows = df.select(F.col(key), utf8(text).alias("__text"))
    schema = rows.select(key, F.lit(b"").alias("token_ids"), F.lit(b"").alias("decoded")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        ids = [own.encode(x) for x in batch.column(1).to_pylist()]
        texts = [own.decode(x) for x in ids]
        columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "token_ids", "decoded"])

    return map_arrow(rows, run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text; nulls, repeats and empty tables as in round_trip()."""
    return round_trip(df, key, text, path).select(
        key,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
