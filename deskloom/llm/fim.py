"""Operator 13: fill-in-the-middle, by a numpy kernel over the UTF-8 buffers of a whole Arrow batch.

A text is cut into lines. One pass over a batch's bytes looks up the class of each byte; comparing neighbours marks where a
line begins, where a code point begins and where a control string stands; running sums, taken from each text's first byte,
number them. The places of all rows' cuts are then found by one binary search in those sums, and the parts are views of the
same buffer. Which cuts and which form a row gets follows from the digest of its id, so every run and every retry agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import fresh, map_arrow

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Classes of bytes: the end of a line, a byte within a code point, and the three bytes of a control string.
END, INSIDE, OPENS, NAMES, CLOSES = 1, 2, 4, 8, 16
CLASS = np.zeros(256, np.uint8)
CLASS[ord("\n")] = END
CLASS[0x80:0xC0] = INSIDE
CLASS[ord("<")] = OPENS
CLASS[list(b"PSM")] = NAMES
CLASS[ord(">")] = CLOSES


class Texts:
    """The bytes of a column of texts, and where each begins and ends; nulls are empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, places, data = column.buffers()
        self.edges = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
        low = int(self.edges[0])
        self.bytes = np.frombuffer(data, np.uint8)[low : int(self.edges[-1])] if data is not None else np.zeros(0, np.uint8)
        self.edges = self.edges - low
        self.kind = CLASS[self.bytes]

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many places of the mask lie before each byte, and before the end."""
        out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def starts(self) -> np.ndarray:
        """Where a line begins: at a text's first byte and after each end of a line, but not at a text's end."""
        mask = np.zeros(len(self.bytes) + 1, bool)
        mask[1:] = self.kind == END
        mask[self.edges[:-1]] = True
        return mask[:-1]

    def controls(self) -> np.ndarray:
        """Where a control string begins; none reaches from one text into the next."""
        kind, mask = self.kind, np.zeros(len(self.bytes), bool)
        if len(kind) > 2:
            mask[:-2] = (kind[:-2] == OPENS) & (kind[1:-1] == NAMES) & (kind[2:] == CLOSES)
            for back in (1, 2):  # one that begins on the last two bytes of a text would
                late = self.edges[1:] - back
                mask[late[late >= 0]] = False
        return mask

    def parts(self, cuts: np.ndarray) -> list[pa.Array]:
        """The texts between neighbouring columns of cuts, rising in each row and from row to row."""
        bounds = np.append(cuts.ravel(), cuts[-1, -1])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.bytes))])
        n = cuts.shape[1]
        return [pieces.take(pa.array(np.arange(k, len(pieces), n))) for k in range(n - 1)]


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in parts], pa.scalar(b"", pa.large_binary()))


def cut(column: pa.Array, h: np.ndarray, plain_from: int, spm_below: int) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) for all texts; h has the four numbers of each row."""
    texts = Texts(column)
    first, last = texts.edges[:-1], texts.edges[1:]
    lines, points, controls = texts.sums(texts.starts()), texts.sums(texts.kind != INSIDE), texts.sums(texts.controls())
    n = (lines[last] - lines[first]).astype(np.int64)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    units = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    # the k-th line of a text ends where the sum first exceeds all lines before it, or with the text
    at = np.searchsorted(lines, lines[first][:, None] + units + 1) - 1
    at = np.minimum(at, last[:, None])
    plain = (first == last) | (controls[last] > controls[first]) | (h[:, 2] % 100 >= plain_from)
    spm = ~plain & (h[:, 3] % 100 < spm_below)
    cuts = np.concatenate([first[:, None], at, last[:, None]], 1)
    prefix, middle, suffix = texts.parts(cuts)
    chars = np.diff(points[cuts], axis=1).astype(np.int64)
    whole = _joined(prefix, middle, suffix)
    psm_text = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm_text = _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    out = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), spm_text, psm_text))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    return [pa.array(n), form, pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), out.cast(pa.large_string()).cast(pa.string())]


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that cut() was given. Both forms hold each control string once, as a text with one stays plain."""
    texts = Texts(output)
    kinds = np.array(form.to_pylist(), object)
    moved = np.isin(kinds, ["psm", "spm"])
    mask = texts.controls()
    held = texts.sums(mask)
    n = held[texts.edges[1:]] - held[texts.edges[:-1]]
    if (n[moved] != 3).any():
        raise ValueError("an output without its three control strings")
    first, last = texts.edges[:-1], texts.edges[1:]
    places = np.flatnonzero(mask).reshape(-1) if mask.any() else np.zeros(0, np.int64)
    mine = held[first][:, None] + np.arange(3)
    at = np.repeat(last[:, None], 3, 1)
    at[moved] = places[mine[moved]]
    cuts = np.stack([first, at[:, 0], np.minimum(at[:, 0] + 3, last), at[:, 1], np.minimum(at[:, 1] + 3, last), at[:, 2], np.minimum(at[:, 2] + 3, last), last], 1)
    whole, _, second, _, third, _, middle = texts.parts(cuts)  # of a plain text, all of it lies before its end
    psm, spm = _joined(second, middle, third), _joined(third, middle, second)
    back = pc.if_else(pa.array(kinds == "psm"), psm, pc.if_else(pa.array(kinds == "spm"), spm, whole))
    return back.cast(pa.large_string()).cast(pa.string())


def numbers(key: Column, seed: int) -> Column:
    """The first four groups of eight digits of the digest of 'seed:key', as numbers; a null key is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for each row of df.

    A null text is empty and stays plain, with no lines; so does a text that holds a control string. Rows that repeat others
    each get a row, equal to theirs; an empty table gives an empty table; extra columns are not carried, whatever their names.
    Texts are read whole; a task holds the rows of a slice of about 1 MB, or one longer text, with some 20 bytes for each of
    its bytes.
    """
    h = fresh("h")
    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"), numbers(F.col(key), seed).alias(h))
    fields = "n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        drawn = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        columns = cut(batch.column(1), drawn, fim_percent, spm_percent)
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[str(i) for i in range(6)])

    return map_arrow(rows, run, f"`{key}` {dict(rows.dtypes)[key]}, {fields}")


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """df with the text that each output was made of; a null form or one that is neither psm nor spm leaves it as it is."""
    schema = df.withColumn(text, F.lit("").cast("string")).schema
    o, f = df.columns.index(output), df.columns.index(form)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = rebuilt(batch.column(o), batch.column(f))
        return pa.RecordBatch.from_arrays([*batch.columns, back], names=[*batch.schema.names, text])

    return map_arrow(df, run, schema)


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of the whole texts."""
    back = restore(fill_in_middle(df))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
    [CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d
), c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM h
), p AS (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
