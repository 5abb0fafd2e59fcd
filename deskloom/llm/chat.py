"""Operator 3: chat formatting at the level of tokens.

Roles and texts are encoded apart from each other, and reserved ids are spliced in between, so no merge ever reaches
across a mark and no text can spell one. The loss mask is the prefix sum of +1 where an assistant's text begins and -1
where it ends. In the string form, a mark that occurs inside a role or text is broken up by an escape character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.bpe import codec, default_path, default_pattern
from deskloom.llm.common import map_arrow, utf8

#: The template's marks and their reserved ids, beyond the 50,256 ranks of the vocabulary.
MARKS = {"[INST]": 50257, "[/INST]": 50258, "</s>": 50259}
OPEN, MIDDLE, CLOSE = MARKS.values()
#: An escape character in a text becomes ESCAPE + "0"; a mark gets ESCAPE + "1" after its first character.
ESCAPE = "␛"
LOSS_ROLE = "assistant"
_OF_ID = {i: s for s, i in MARKS.items()}
_SPECIAL = re.compile("|".join(map(re.escape, [ESCAPE, *MARKS])))
_ESCAPED = re.compile(ESCAPE + "([01])")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0][0] + ESCAPE + "1" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


def segments(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """(conv_id, turn, role, text, token_ids, loss_mask) for each row of df: a turn's tokens and their mask.

    A conversation's token stream is its turns' token_ids in the order of (turn, role, text), nulls first. token_ids are
    packed little-endian unsigned 32-bit integers, loss_mask a byte a token. Null roles and texts are read as empty.
    """
    path, pattern = path or default_path(), default_pattern()
    rows = df.select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        utf8(role).alias("role"), utf8(text).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, ids, masks = codec(path, pattern), [], []
        for r, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            head, body = (np.frombuffer(own.encode(escape(s)), "<u4") for s in (r, x))
            ids.append(np.concatenate([[OPEN], head, [MIDDLE], body, [CLOSE]]).astype("<u4").tobytes())
            change = np.zeros(len(head) + len(body) + 4, np.int8)
            if r == LOSS_ROLE:
                change[len(head) + 2] += 1
                change[len(head) + 2 + len(body)] -= 1
            masks.append(np.cumsum(change, dtype=np.int8)[:-1].tobytes())
        columns = [*batch.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "token_ids", "loss_mask"])

    return map_arrow(rows, run, "conv_id long, turn long, role string, text string, token_ids binary, loss_mask binary")


class Reader:
    """Reads one conversation back from its tokens, turn by turn, holding one turn at a time."""

    def __init__(self, conversation: int | None, path: str, pattern: str):
        self.conversation, self.codec = conversation, codec(path, pattern)
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, packed: bytes, mask: bytes) -> None:
        ids, under = np.frombuffer(packed, "<u4"), np.frombuffer(mask, np.int8).astype(bool)
        marks = np.flatnonzero(ids >= OPEN)
        if list(ids[marks]) != [OPEN, MIDDLE, CLOSE]:
            raise ValueError("not one turn")
        role, text = (self.codec.decode(ids[a + 1 : b].tobytes()).decode("utf-8") for a, b in zip(marks, marks[1:], strict=False))
        self.turns += 1
        self.formatted_chars += len(role) + len(text) + sum(len(_OF_ID[int(i)]) for i in ids[marks])
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        lost = unescape(self.codec.decode(ids[under].tobytes()).decode("utf-8"))
        self.loss_chars += len(lost)
        self.loss.update(lost.encode())

    def row(self) -> tuple:
        return self.conversation, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read from segments()' tokens.

    Rows without a conv_id are one conversation, repeated turns are turns of their own, ties of turn go by role and text, and
    an empty table gives an empty table.

    Turns are sorted within their conversation and read as a stream: memory is bounded by a turn, whatever the length of
    a conversation. The digest of one conversation is sequential by its nature; encoding is not, and is done before.
    """
    path, pattern = path or default_path(), default_pattern()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = (
        assembled.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "token_ids", "loss_mask")
    )

    def packed(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None
        for batch in batches:
            done = []
            for conversation, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or reader.conversation != conversation:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conversation, path, pattern)
                reader.read(ids, mask)
            if done:
                yield packed(done)
        if reader is not None:
            yield packed([reader.row()])

    return rows.mapInArrow(run, schema)
