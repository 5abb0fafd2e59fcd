"""Operator 7: toxicity by a weighted lexicon.

Texts are folded first: case, compatibility forms, accents, letters of other scripts that look Latin, and digits and signs
that stand for letters inside words. The lexicon's terms are whole words and beginnings of words; an Aho-Corasick automaton
finds them at word starts in one pass, and each distinct word counts its heaviest term, once. Words within an exception phrase count for
nothing. The sum of weights and the sum normalised by the text's length give a score by a logistic curve.

Weights, exceptions and curve are learnt from labelled rows outside the held-out fold, on a bounded sample of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, fresh, map_arrow, utf8

#: Labelled rows that the lexicon is fitted on, at most; its terms and phrases are those of these rows.
FIT_ROWS = 20_000
FOLDS = 5
#: Lengths of the word beginnings that may become terms.
STEMS = (4, 5, 6)
#: A term needs this many toxic rows, a log-likelihood ratio above the log of the number of terms, and this log odds ratio.
LEAST_ROWS, LEAST_WEIGHT = 3, 3.0
#: A stem is left out if one whole word has this share of its rows.
OWED = 0.8
#: An exception phrase is seen in this many clean rows and in no toxic one.
EXCEPTION_ROWS = 3
#: Term counts that a task holds before it hands them on.
HELD_TERMS = 100_000

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip("авекмнорстухіјѕԁԛԝһӏαβεικνορτυχγωɡıℓ", "abekmhopctyxijsdqwhlabeiknoptuxywgil", strict=True)
)
#: Digits and signs that stand for letters within words.
SUBSTITUTES = dict(zip("01345789@$!|+", "oieastbgasilt", strict=True))
_LOOK = str.maketrans(HOMOGLYPHS)
_STAND_IN = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+(?:[@$!|+][^\W_]+)*")
_MIXED = re.compile(r"[0-9@$!|+]")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> list[str]:
    """The words of text in folded form."""
    low = text.casefold()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
        low = "".join(c for c in low if not unicodedata.combining(c)).translate(_LOOK)
    words = _WORD.findall(low)
    return [w if w.isalpha() or not _MIXED.search(w) or not _LETTER.search(w) else w.translate(_STAND_IN) for w in words]


def terms_of(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) >= n)]


@dataclass
class Lexicon:
    """Weights of terms (" word " or " stem"), exception phrases, and the logistic curve's three coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    @cached_property
    def automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            automaton.add_word(term, (len(term), weight))
        automaton.make_automaton()
        return automaton

    def hits(self, words: list[str]) -> dict[int, float]:
        """The weight of each word (by its place) that a term finds and no exception covers."""
        if not self.weights or not words:
            return {}
        text = f" {' '.join(words)} "
        found: dict[int, float] = {}
        for end, (size, weight) in self.automaton.iter(text):
            start = end + 1 - size
            found[start] = max(found.get(start, 0.0), weight)
        if not found:
            return {}
        starts = {at: i for i, at in enumerate(_starts(words))} if len(found) > 4 else None
        out = {(starts[at] if starts else text.count(" ", 0, at + 1) - 1): w for at, w in found.items()}
        if self.exceptions:
            pair = lambda i, j: 0 <= i and j < len(words) and f"{words[i]} {words[j]}" in self.exceptions
            out = {i: w for i, w in out.items() if not pair(i - 1, i) and not pair(i, i + 1)}
        return out

    def features(self, text: str) -> tuple[float, float]:
        words = fold(text)
        total = sum({words[i]: w for i, w in self.hits(words).items()}.values())
        return float(np.log1p(total)), total / (len(words) + 20) ** 0.5

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def _starts(words: list[str]) -> list[int]:
    at, out = 0, []
    for w in words:
        out.append(at)
        at += len(w) + 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Coefficients by Newton's method, with a small penalty that keeps them finite when classes part cleanly."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(key: str):
    """Whether a row is in the held-out fold: crc32 of the key's text modulo 5 is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % FOLDS == 0, F.lit(False))


def chosen_terms(terms: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of (term, toxic rows, weight), without the stems that owe nearly all of their rows to one whole word."""
    owed: Counter = Counter()
    for term, rows, _ in terms:
        if term.endswith(" "):
            for n in STEMS:
                stem = term[: n + 1]
                owed[stem] = max(owed[stem], rows)
    return {term: weight for term, rows, weight in terms if term.endswith(" ") or owed[term] < OWED * rows}


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon learnt from labelled rows that are not held out, at most fit_rows of them, chosen by a hash.

    Equal texts with equal labels count once. A key that several documents or labels share gives all their texts with all
    their labels. Without any labelled row, or with rows of one class only, it is empty and scores every text 0 or so.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .select(F.col(key).alias("k"), (F.col(label) != 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(fit_rows)
    )
    texts = documents.select(F.col(key).alias("own"), utf8(text).alias("x"))
    sample = checkpointed(texts.join(F.broadcast(chosen), F.col("own") == F.col("k")).select("x", "y").distinct())  # fit_rows rows of two numbers
    if sample.limit(fit_rows + 1).count() > fit_rows:  # keys of many documents
        digest = F.xxhash64("x", "y")
        last = sample.select(digest.alias("h")).orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
        sample = sample.where(digest <= last)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update({t for w in set(fold(x)) for t in terms_of(w)})
                if len(held[0]) + len(held[1]) > HELD_TERMS:
                    yield _counts(held)
                    held = (Counter(), Counter())
        if held[0] or held[1]:
            yield _counts(held)

    counts = sample.mapInArrow(counted, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t + c >= {LEAST_ROWS}")
    counts = checkpointed(counts)
    bar = float(np.log(max(2, counts.count())))
    share = toxic / (toxic + clean)
    t, c = F.col("t"), F.col("c")
    log = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0.0)
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    kept = counts.where((t >= LEAST_ROWS) & (t > (t + c) * share) & (log(t, share) + log(c, 1 - share) > bar)).select("term", "t", weight.alias("w")).where(f"w >= {LEAST_WEIGHT}")
    lexicon = Lexicon(chosen_terms([tuple(r) for r in kept.collect()]))

    def around(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        phrases, ys = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = fold(x)
            near = {f"{words[i]} {words[i + 1]}" for at in lexicon.hits(words) for i in (at - 1, at) if 0 <= i < len(words) - 1}
            phrases += near
            ys += [y] * len(near)
        return pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(ys, pa.int32())], names=["phrase", "y"])

    seen = map_arrow(sample, around, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    lexicon.exceptions = {r["phrase"] for r in seen.where(f"t = 0 AND n >= {EXCEPTION_ROWS}").select("phrase").collect()}

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [lexicon.features(x) for x in batch.column(0).to_pylist()]
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(1)], names=["a", "b", "y"])

    rows = np.array([tuple(r) for r in map_arrow(sample, featured, "a double, b double, y int").collect()], float)  # fit_rows rows, copies apart
    lexicon.curve = logistic(rows[:, :2], rows[:, 2])
    return lexicon


def _counts(held: tuple[Counter, Counter]) -> pa.RecordBatch:
    clean, toxic = held
    terms = list(clean.keys() | toxic.keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "t", "c"])


def scored(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """df with one more column: each whole text's score from 0 to 1, null read as empty. A column named as it is replaced."""
    kept = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(fresh("scored")))
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # terms and phrases of fit_rows rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        score = [own.score(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], out])

    return map_arrow(rows, run, df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(0.0)).schema)


def toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of documents, repeats included.

    Rows without a key are not held out; empty and null texts have the score of a text without terms. Labels, or any
    column but the text, are no inputs of a score; a label is learnt from only if its row is not held out.
    """
    lexicon = fit(documents, labels, key, text)
    return scored(documents.select(key, text), lexicon, text).select(
        key, held_out(key).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
