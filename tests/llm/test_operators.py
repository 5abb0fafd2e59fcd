"""The training-data operators against brute-force versions, on tables with the cases that their docstrings define."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from deskloom.llm import bpe, chat, embedding_dedup, html_main, licenses, mixing, queries, simhash, token_counts, topk, toxicity
from deskloom.llm.common import forest, slices, small_batches
from deskloom.operators.graph import components
from deskloom.llm.license_rules import BASE_CONFIDENCE, CONFIDENCE, LONGEST, rules

RNG = random.Random(5)
WORDS = [chr(RNG.randrange(97, 123)) * RNG.randrange(1, 4) + RNG.choice(["", "ing", "é", "ß"]) for _ in range(60)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(120_000))
BASE = [" ".join(RNG.choice(WORDS) for _ in range(n)) for n in (3, 40, 200, 200, 300)]
NEAR = [BASE[3].replace(BASE[3].split()[50], "changed", 1) + f" {i}" for i in range(6)]
TEXTS = [
    None, "", "   \n\t", "one", "Two WORDS", LONG, *BASE, *BASE[2:4], *NEAR, "a" * 5000, "\u0000odd\u0085 \u001c x", "<|endoftext|> x<|endoftext|>",
    "Released under the MIT License. mit license, Apache License, Version 2.0; the GNU General Public License v3", "no break  dash–end 😀😀", "mit license " * 300,
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "x", f"s{i % 3}" if i % 5 else None, 1.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, component_id string")


def empty(spark):
    return documents(spark).limit(0)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_forest():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        a, b = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert (forest(a, b, n) == want).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = [x for x in links if None not in x]
    names = sorted({n for x in ends for n in x})
    at = {n: i for i, n in enumerate(names)}
    want = forest(np.array([at[a] for a, _ in ends]), np.array([at[b] for _, b in ends]), len(names))
    assert got == {n: names[want[at[n]]] for n in names if want[at[n]] != at[n]}


# operator 4


def test_bpe_equals_the_library(spark, tiktoken_encoding):
    got = {r["doc_id"]: r for r in bpe.digests(documents(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty(spark)).count() == 0


def test_bpe_on_odd_pieces(tiktoken_encoding):
    own = bpe.codec(bpe.default_path(), bpe.default_pattern())
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice([chr(rng.randrange(32, 0x250)), "ab", "the", "\n", " ", "aaaa", chr(rng.randrange(0x3000, 0x3100))]) for _ in range(rng.randrange(80)))
        assert own.encode(text) == np.array(tiktoken_encoding.encode_ordinary(text), "<u4").tobytes()


def test_bpe_columns_stay(spark):
    out = bpe.decode(bpe.encode(documents(spark, ["a b", None]).withColumnRenamed("lang", "token_ids")))
    assert out.columns == ["doc_id", "text", "source", "score", "component_id", "token_ids", "decoded"]
    assert sorted(bytes(r["decoded"]) for r in out.collect()) == [b"", b"a b"]


# operator 6


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    got = {r["doc_id"]: r for r in token_counts.counts(documents(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.counts(empty(spark)).count() == 0


# operator 3


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST]␛1 ok␛ [/INST]"), (1, 1, "assistant", "tie"), (1, 2, None, None), (2, None, "system", "x"),
        (2, 0, "assistant", None), (3, 0, "user", ""), (4, 0, "assistant", LONG), (4, 0, "assistant", LONG), (None, 0, "user", "lost"), (5, 1, "[INST]", "[[INST]]"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, token_ids int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(df)).collect()}
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append(((n is not None, n or 0), r or "", t or ""))
    assert got.keys() == by.keys()
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        want = "".join(f"[INST]{chat.escape(r)}[/INST]{chat.escape(t)}</s>" for _, r, t in rows)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["formatted_chars"]) == (len(rows), len(loss), len(want))
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "␛", "␛0␛1", "</s>[INST] ok [/INST]", "<</s>>", "[/[INST]INST]", "[␛1INST]"])
def test_escapes_are_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(m in safe for m in chat.MARKS)


# operator 5


def brute_licenses(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    known = [(r, re.compile(r.pattern.replace("(?= |$)", r"(?= |\Z)"))) for r in rules()]
    found = []
    for i, w in enumerate(words):
        for r, pattern in known:
            if w == r.keyword and i >= r.before and (m := pattern.match(" ".join(words[i - r.before : i - r.before + LONGEST]))):
                found.append((i - r.before, m[0].count(" ") + 1, r))
    kept = []
    for s, n, r in found:
        held = any(a <= s and a + b >= s + n and (q.level < r.level or (q.level == r.level and b > n)) for a, b, q in found)
        if r.base or not held:
            kept.append(r)
    base = [s for s, _, r in found if r.base]
    score = max((BASE_CONFIDENCE if r.base else CONFIDENCE[r.level] for r in kept), default=0.0)
    joined = lambda labels: ",".join(sorted(set(labels)))
    return len(words), len(base), min(base, default=None), max(base, default=None), joined(r.label for _, _, r in found if r.base), joined(r.label for r in kept), score


def test_dense_license_texts_take_linear_time(spark):
    """16,000 repeats of a phrase: every place is counted, in seconds."""
    import time

    text = "mit license " * 16_000
    began = time.monotonic()
    row = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (32_000, 16_000, 0, 31_998, "mit")
    assert time.monotonic() - began < 60


def test_every_rule_is_found_by_its_literal():
    grouped = licenses.by_literal(rules())
    assert sum(map(len, grouped.values())) == len(rules())
    assert max(map(len, grouped.values())) < 10


def test_licenses(spark):
    texts = [t for t in TEXTS if t is not LONG] + ["SPDX-License-Identifier: GPL-2.0-or-later", "BSD 3-Clause License", "x" * 3 + " MIT", "Licensed under CC BY-NC 4.0.", "All rights reserved", "éMIT License", "mit  -- LICENSE"]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.licenses(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute_licenses(t or ""), t
    assert licenses.licenses(empty(spark)).count() == 0
    assert len(rules()) > 200


# operator 9


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    got = {r["doc_id"]: r for r in simhash.classes(documents(spark)).collect()}
    fps = [brute_fingerprint(t or "") for t in TEXTS]
    assert [got[i]["fingerprint"] for i in range(len(TEXTS))] == [f"{f:016x}" for f in fps]
    n = len(fps)
    pairs = [(i, k) for i in range(n) for k in range(n) if (fps[i] ^ fps[k]).bit_count() <= 3]
    want = forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), n)
    assert [got[i]["component_id"] for i in range(n)] == want.tolist()
    assert simhash.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_simhash_links_find_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    hub = base[0] ^ np.array([1 << int(b) | 1 << int(c) for b, c in rng.integers(0, 64, (150, 2))], np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    fp = np.unique(np.concatenate([base, near, hub]))
    at = {int(f): i for i, f in enumerate(fp.view(np.int64))}
    got = [(at[r["a"]], at[r["b"]]) for r in simhash.links(spark.createDataFrame([(f,) for f in at], "fp long")).collect()]
    i, k = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    n = len(fp)
    assert (forest(*np.array(got).T, n) == forest(i, k, n)).all()


def test_representatives(spark):
    same, other, third = "same text here", "other words altogether now", "a third one of them stays"
    rows = [(None, same, 1), (3, same, 1), (3, same, 1), (2, same, 1), (3, other, 2), (3, third, 3), (None, "lone", 4), (None, "lone", 4), (5, None, 5), (6, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int").selectExpr("*", "first AS n", "first AS fp", "first AS `a.b`")
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert Counter(tuple(r)[:3] for r in got.collect()) == Counter([(2, same, 1), (3, other, 2), (3, third, 3), (None, "lone", 4), (5, None, 5)])
    assert simhash.representatives(df.limit(0)).count() == 0


def test_null_keys(spark):
    df = spark.createDataFrame([(None, "same text here"), (3, "same text here"), (None, "other words altogether now"), (3, "same text here")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.classes(df).collect())
    assert got == {(None, 3): 1, (3, 3): 2, (None, None): 1}


# operator 1


@pytest.mark.parametrize("bytes_", [1 << 20, 1 << 12])
def test_embedding_dedup(spark, monkeypatch, bytes_):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(embedding_dedup, "COPY_COST", 0)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, base[i % 400 if i < 700 else 0] + rng.normal(size=8).astype(np.float32) * (0.05 if i >= 400 else 0), int(i % 3) if i % 7 else None) for i in range(900)]
    rows += [(1000 + i, base[1], 1) for i in range(30)]
    data = [(i, [float(x) for x in v], g, 9) for i, v, g in rows]
    data += [(2000, None, 1, 9), (2001, [0.0] * 8, 1, 9), (2002, [float("nan")] * 8, 1, 9), (2003, [None] + [1.0] * 7, 1, 9), (2004, [], 1, 9), (2005, [1.0, 2.0], 1, 9), (2006, [2.0, 4.0], 1, 9), (None, [1.0] * 8, 1, 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, kept int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    ok = [(i, np.array(v), g) for i, v, g, _ in data if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(ok)
    hit = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1].astype(float), ok[b][1].astype(float)
                hit[a, b] = hit[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    comp = forest(*np.nonzero(hit), n)
    want = {d[0]: (0, d[0]) for d in data} | {ok[a][0]: (int(hit[a].sum()), min(ok[b][0] for b in range(n) if comp[b] == comp[a])) for a in range(n)}
    assert len(got) == len(data)
    for key, (links, component) in want.items():
        assert (got[key]["n_links"], got[key]["component_id"], got[key]["kept"]) == (links, component, key is not None and component == key)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# operator 10


@pytest.mark.parametrize(("block", "share", "pairs"), [(1 << 20, 1 << 20, 1 << 20), (4096, 1 << 16, 300)])
def test_top_k(spark, monkeypatch, block, share, pairs):
    monkeypatch.setattr(topk, "QUERY_BYTES", block)
    monkeypatch.setattr(topk, "SHARE_BYTES", share)
    monkeypatch.setattr(topk, "PAIRS", pairs)
    rng = np.random.default_rng(7)
    data = [(int(i), [float(x) for x in np.round(rng.normal(size=70), 2)]) for i in range(-60, 400)]
    data += [(500 + i, data[3][1]) for i in range(12)]  # ties
    data += [(600, None), (650, [None] * 70), (700, [float("inf")] * 70), (750, [0.0] * 70), (800, [1.0, 2.0]), (801, [3.0, 4.0]), (None, [1.0] * 70), (850, [1e12] * 70)]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.search(df).collect())
    import math

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q, x in ok:
        if q % 50 == 0:
            scores = sorted((-clip(sum(a * b for a, b in zip(x, y, strict=True))), i) for i, y in ok if i != q and len(y) == len(x))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk.search(df.limit(0)).count() == 0


def test_a_full_block_of_queries_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(11)
    n = topk.QUERY_BYTES // (8 * 64)
    queries = np.floor(256 * rng.normal(size=(n, 64)))
    candidates = np.floor(256 * rng.normal(size=(256, 64)))
    tracemalloc.start()
    best = topk.Best(np.arange(n), queries, 5)
    best.add(np.arange(n, n + 256), candidates)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert best.rows().num_rows == 5 * n
    scores = queries[:50] @ candidates.T
    assert (best.score[:50] == -np.sort(-scores, axis=1)[:, :5]).all()


def test_tight_negative_bounds_drop_nothing():
    """Constant opposite vectors: bound, floor and score are equal and far below zero."""
    best = topk.Best(np.array([0]), np.full((1, 64), 256.0), 5, np.array([-(256 * 256 * 64)]))
    best.add(np.arange(1, 7), np.full((6, 64), -256.0))
    assert best.held[0] == 5 and best.who[0].tolist() == [1, 2, 3, 4, 5] and set(best.score[0].tolist()) == {-4194304}


def test_bounds_are_bounds():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 70)) + 1, rng.normal(size=(40, 70))
    exact = a @ b.T
    loose = None
    for segments in topk.LEVELS:
        bound = topk.statistics(a, segments) @ topk.statistics(b, segments).T
        assert (bound >= exact - 1e-9).all()
        assert loose is None or bound.mean() <= loose
        loose = bound.mean()


# operator 2


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rng = random.Random(9)
    sizes = {"big": 900, "mid": 200, "small": 60, None: 30, "void": 3}
    rows = [(i, s, "" if s == "void" else " ".join("w" for _ in range(rng.randrange(1, 30)))) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, source string, text string, mix_pass int")
    out = mixing.mix(df, max_repeats=3.0)
    assert out.columns == ["doc_id", "source", "text", "mix_pass", "mix_block", "mix_position", "mix_order"]
    got = out.collect()
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(t.split())
    live = {s: n for s, n in tokens.items() if n}
    low, high = 0.0, 1.0  # plain bisection
    for _ in range(60):
        middle = (low + high) / 2
        repeats = (max(live.values()) / min(live.values())) ** (1 - middle)
        low, high = (low, middle) if repeats <= 3 else (middle, high)
    for s, n in live.items():
        taken = sum(len(r["text"].split()) for r in got if r["source"] == s)
        target = (n / max(live.values())) ** (high - 1) * n
        assert target - 1 <= taken <= target + 30
    seen = Counter((r["doc_id"], r["mix_pass"]) for r in got)
    assert max(seen.values()) == 1 and {r["doc_id"] for r in got} == {r[0] for r in rows}
    passes = defaultdict(set)
    for r in got:
        passes[r["source"]].add(r["mix_pass"])
    assert max(passes["big"]) == 0 and all(p == set(range(len(p))) for p in passes.values())
    turns = defaultdict(list)
    for r in got:
        turns[r["source"], r["mix_pass"]].append((r["mix_position"], r["mix_block"], r["doc_id"]))
    for rows_ in turns.values():  # a permutation in which blocks stand together
        rows_.sort()
        assert [p for p, _, _ in rows_] == list(range(len(rows_)))
        blocks = [b for _, b, _ in rows_]
        assert sum(a != b for a, b in zip(blocks, blocks[1:], strict=False)) == len(set(blocks)) - 1
        assert len(rows_) < 50 or [d for _, _, d in rows_] != sorted(d for _, _, d in rows_)
    assert [d for _, _, d in turns["mid", 0]] != [d for _, _, d in turns["mid", 1]][: len(turns["mid", 0])]
    in_order = [r["source"] for r in sorted(got, key=lambda r: r["mix_order"])]  # sources are interleaved evenly
    half = Counter(in_order[: len(in_order) // 2])
    assert all(abs(half[s] - n / 2) <= 3 for s, n in Counter(in_order).items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_odd_rows(spark):
    """Null keys, sources and texts, repeated rows, a long text and clashing names: rows with equal weights are each taken once."""
    rows = [(None, "a", "one two", 1)] * 3 + [(7, None, "three four five", 2), (7, None, "other text here", 2), (8, "a", None, 3), (8, "a", "", 3), (9, "b", LONG, 4), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n long").withColumnRenamed("n", "left").selectExpr("*", "left AS rank", "left AS s", "left AS `a.b`")
    got = mixing.mix(df, max_repeats=1.0)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(rows)
    counted = mixing.mix(df, tokens="left", max_repeats=None, budget=40).collect()  # sources of 9, 4 and 4 tokens, each to give 40 / 3
    assert {r["mix_pass"] for r in counted if r["source"] == "b"} == {0, 1, 2, 3} and {r["mix_pass"] for r in counted if r["source"] == "a"} == {0, 1}


def test_mixing_targets(spark):
    shares = spark.createDataFrame([(n,) for n in (1000, 100, 10)], "tokens long")
    p = np.array([1000, 100, 10]) / 1110
    for target in (0.5, 0.9, 1.0):
        e = mixing.solve(shares, entropy=target)
        w = p**e / (p**e).sum()
        assert -(w * np.log(w)).sum() == pytest.approx(target, abs=1e-5)
    assert mixing.solve(shares, entropy=2.0) == 0.0 and mixing.solve(shares, entropy=0.1) == 1.0
    e = mixing.solve(shares, max_repeats=5, budget=1110)
    assert ((p**e / (p**e).sum()) * 1110 / np.array([1000, 100, 10])).max() == pytest.approx(5, rel=1e-4)


def test_mixing_budget(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "a b c") for i in range(400)], "doc_id long, source string, text string")
    got = mixing.mix(df, budget=600, max_repeats=None)
    assert got.count() == 200 and got.select("doc_id").distinct().count() == 200


# operator 7


def toxic_tables(spark):
    rng = random.Random(10)
    bad = ["vilewordo", "nastyterm", "grimslur"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            words += rng.sample(bad, 2)
        elif i % 37 == 0:
            words += ["not", "nastyterm", "here"]
        rng.shuffle(words) if toxic else None
        rows.append((i, " ".join(words), "label leaks" if toxic else "", 7.0))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 900
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(i % 6 == 0, got[i]["predicted"]) for i in got if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(encode(string(doc_id), 'utf-8')) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a == b


def brute_lexicon(rows, labels):
    """The lexicon by its definition: plain counts of every term over the labelled rows outside the held-out fold."""
    from math import log

    by = {k: bool(y) for k, y in labels if k is not None and y is not None and zlib.crc32(str(k).encode()) % 5}
    sample = {(x or "", by[k]) for k, x in rows if k in by}
    toxic = sum(y for _, y in sample)
    clean = len(sample) - toxic
    seen = {True: Counter(), False: Counter()}
    for x, y in sample:
        words = set(toxicity.fold(x))
        seen[y].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in toxicity.STEMS if len(w) >= n})
    terms = {t for t in seen[True] | seen[False] if seen[True][t] + seen[False][t] >= toxicity.LEAST_ROWS}
    share, bar, kept = toxic / len(sample), log(max(2, len(terms))), {}
    for term in terms:
        t, c = seen[True][term], seen[False][term]
        ratio = sum(n * log(n / ((t + c) * p)) for n, p in ((t, share), (c, 1 - share)) if n)
        weight = log((t + 0.5) / (toxic + 1)) - log((c + 0.5) / (clean + 1))
        if t >= toxicity.LEAST_ROWS and t > (t + c) * share and ratio > bar and weight >= toxicity.LEAST_WEIGHT:
            kept[term] = weight
    whole = [t for t in kept if t.endswith(" ")]
    weights = {t: w for t, w in kept.items() if t in whole or all(not x.startswith(t) or seen[True][x] < toxicity.OWED * seen[True][t] for x in whole)}
    around = {True: Counter(), False: Counter()}
    for x, y in sample:
        words = toxicity.fold(x)
        hit = [i for i, w in enumerate(words) if any(f" {w} ".startswith(t) for t in weights)]
        around[y].update({f"{words[i]} {words[i + 1]}" for at in hit for i in (at - 1, at) if 0 <= i < len(words) - 1})
    return sample, weights, {p for p, n in around[False].items() if n >= toxicity.EXCEPTION_ROWS and not around[True][p]}


def brute_features(text, weights, exceptions):
    words = toxicity.fold(text)
    found = {}
    for i, w in enumerate(words):
        own = [v for t, v in weights.items() if f" {w} ".startswith(t)]
        near = {" ".join(p) for p in (words[max(i - 1, 0) : i + 1], words[i : i + 2]) if len(p) == 2}
        if own and not near & exceptions:
            found[w] = max(own)
    return np.log1p(sum(found.values())), sum(found.values()) / (len(words) + 20) ** 0.5


def test_toxicity_equals_its_definition(spark):
    docs, labels = toxic_tables(spark)
    lexicon = toxicity.fit(docs, labels)
    rows, marks = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["toxic"]) for r in labels.collect()]
    sample, weights, exceptions = brute_lexicon(rows, [m for m in marks if m != (3, None)])
    assert lexicon.weights == pytest.approx(weights) and lexicon.exceptions == exceptions and weights and exceptions
    x = np.array([[1, *brute_features(t, weights, exceptions)] for t, _ in sorted(sample)])
    y, w = np.array([y for _, y in sorted(sample)], float), np.array(lexicon.curve)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.array([1e-6, 1e-2, 1e-2]) * w
    assert np.abs(slope).max() < 1e-4  # the curve is the penalised likelihood's maximum
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    for k, text in rows:
        want = 1 / (1 + np.exp(-np.clip(np.array([1, *brute_features(text or "", weights, exceptions)]) @ w, -30, 30)))
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_toxicity_fits_on_a_bounded_sample_of_a_repeated_key(spark):
    docs = spark.createDataFrame([(2, f"vile{i} text", "x") for i in range(50)] + [(1, "clean text", "y")], "doc_id long, text string, __scored string")
    labels = spark.createDataFrame([(2, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, fit_rows=20)
    out = toxicity.scored(docs, lexicon)
    assert out.columns == ["doc_id", "text", "__scored", "score"] and out.count() == 51


def test_toxicity_edges(spark):
    docs, labels = toxic_tables(spark)
    lexicon = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "V1LEW0RDO nаstyterm"), (3, LONG)], "doc_id long, text string")
    got = [r["score"] for r in toxicity.scored(odd, lexicon).collect()]
    assert got[0] == got[1] < 0.5 < got[2]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " vile": 4.0}, {"trash can"})
    assert lexicon.hits(toxicity.fold("The TRASH can, tr4sh v1leness")) == {3: 5.0, 4: 4.0}


def test_folding():
    assert toxicity.fold("ＩＤ１ＯＴ Ídiot 1d10t $tupid 1984 а.b") == ["idiot", "idiot", "idiot", "$tupid"[1:], "1984", "a", "b"]


# operator 8


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("<p>a &amp; b&#33;</p><p> c\n d </p>", "a & b! c d"),
        ("<nav>x</nav><article><h1>T</h1><p>one<br>two <b>thr</b>ee</p></article><footer>f</footer>", "T one two three"),
        ("<div class='cookie-notice'>x</div><main><p>m</p><section id=comments><p>c</p></section><aside>s</aside></main>", "m"),
        ("<article><script>var a='<p>x</p>'</script><p>kept<style>p{}</style></article>", "kept"),
        ("<body><article><p>a<p>b<div class=ad>x</div>c</body>", "a b c"),
        ("<article>a<!-- <p>x</p> -->b</article><article class='comment'>no</article>", "ab"),
        ("<article><form>f<input value='x'></form><ul><li>i<li>j</ul></article>", "i j"),
        ("< p>5 < 6</p>", "< p>5 < 6"),
        ('<main><article class="post search-result"><p>hello</p></article><p class="notice">n</p></main>', "hello"),
        ("<!-- <article>no</article> --><p>open</p>", "open"),
        ("<aside><article>no</article></aside><p>open</p>", "open"),
        ("<article>one <span class='ad'>buy <b>now</b></span> two</article>", "one two"),
        ("<article><p class=notice><b>n<p>kept</p></article>", "kept"),
        ("<article>a</b>b</i><b>c</article></b>d", "abc"),
        ("<article><p>x <a title='a > b' href=/q?a>y</a> z</p></article>", "x y z"),
        ("<article>a<![CDATA[ <b> & ]]>b<![CDATA[ c > d</article>", "a <b> & b d"),
        ("<article>&#" + "0" * 9000 + "65;&#" + "9" * 9000 + "; &#x41;</article>", "A\ufffd A"),
        ("<article>kept</article><p class='never ends", "kept"),
        ('<div class="content with-sidebar"><article><p>hello world</p></article></div>', "hello world"),
        ('<div class="no-sidebar"><p>open</p></div>', "open"),
        ('<div class="post search"><article><p>a</p></article><p>b</p></div>', "a"),
        ('<div class="post search"><p>open</p></div>', "open"),
        ('<div class="banner"><main><p>a</p></main><p>b</p></div>', "a"),
        ('<div class="related-posts related"><article><p>teaser</p></article></div><article><p>a</p></article>', "a"),
        ('<div class="sidebar"><article><p>teaser</p></article></div><article><p>a</p></article>', "a"),
        ('<div hidden><article><p>no</p></article></div><p style="display: none">no</p><p>open</p>', "open"),
        ('<article data-title="Some hidden treasures of Rome"><p title="a hidden gem">a</p><p class="hidden lg:flex">b</p><p hidden>c</p><p class=x hidden=until-found>d</p></article>', "a b"),
        ('<article><p data-class="ad" title=\'class="comments"\'>a</p></article>', "a"),
        ('<article><div class="post-header"><h1>T</h1></div><p class="intro-banner">one</p><header><h1>H</h1><p>by</p><div>tools</div><nav>n</nav></header>two</article>', "T one H by two"),
        ('<header><h1>Site</h1></header><article>a<footer>f</footer></article>', "a"),
        ('<div role="main"><p>a</p><div role="navigation">n</div><section id="postComments"><p>c</p></section><ol class="comment-list"><li>c</ol></div>', "a"),
        ('<article>a<span class="adSlot">x</span><div class="ad-728">x</div><p class="adventure comment-free">b</p><div class="newsletter-signup">x</div></article>', "a b"),
        ('<main class="search sidebar"><p>a</p></main><article class="comment"><p>c</p></article>', "a"),
    ],
)
def test_blocks(html, want):
    page, has_mark = html_main.blocks(html)
    assert html_main.judged(page, has_mark, [])[0] == want


@pytest.mark.parametrize("part", ["<![CDATA[", '<b class="', "<b ", "<!--", "<div>", "<b>", "</p>", "<p><b>", "<div></span>", "<script", "<a href='", "=  ", "<span class=ad><i>", "&#", "<", "</", "<!"])
def test_a_megabyte_of_hostile_markup_takes_linear_time(part):
    import time

    began = time.process_time()
    html_main.blocks(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 3


def brute_boilerplate(pages):
    """By page: the (block, token) pairs that a substring of SPAN tokens or more, or a whole short block, of another page covers."""
    texts = [[t.split(" ") for _, _, t in own] for _, own in pages]
    out = [set() for _ in pages]
    for p, (host, own) in enumerate(pages):
        for q, (other, theirs) in enumerate(pages):
            if host != other or own == theirs:
                continue
            for b, (zone, prose, _) in enumerate(own):
                for c, (zone2, prose2, _) in enumerate(theirs):
                    if html_main.ARTICLE in (zone, zone2):
                        continue
                    x, y = texts[p][b], texts[q][c]
                    if len(x) < html_main.SPAN:
                        if x == y and not prose and not prose2:
                            out[p] |= {(b, i) for i in range(len(x))}
                        continue
                    for i in range(len(x)):
                        for k in range(len(y)):
                            n = 0
                            while i + n < len(x) and k + n < len(y) and x[i + n] == y[k + n]:
                                n += 1
                            if n >= html_main.SPAN:
                                out[p] |= {(b, i + j) for j in range(n)}
    return out


def test_suffixes_find_what_every_pair_of_pages_shares():
    rng = random.Random(12)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (10, 12, 25, 9, 3, 1)]
    pages = []
    for i in range(14):
        own = []
        for _ in range(rng.randrange(5)):
            text = " ".join(rng.choice([rng.choice("abcdefgh"), f"u{i}", rng.choice(passages)]) for _ in range(rng.randrange(1, 9)))
            own.append((rng.choice([html_main.OPEN, html_main.OTHER, html_main.ARTICLE]), rng.random() < 0.5, rng.choice([text, rng.choice(passages)])))
        pages.append((f"h{i % 2}", own))
    pages.append(pages[3])
    found = html_main.Suffixes(pages)
    seen = defaultdict(set)
    for (p, _, _), c in zip(found.at.tolist(), found.own.tolist(), strict=True):
        seen[c].add(str(pages[p]))
    got = [set() for _ in pages]
    for (p, b, k), c in zip(found.at.tolist(), found.own.tolist(), strict=True):
        if len(seen[c]) > 1:
            got[p] |= {(b, k + j) for j in range(html_main.SPAN) if k + j <= pages[p][1][b][2].count(" ")}
    assert got == brute_boilerplate(pages)
    assert len(set(found.hashes.tolist())) == len(found.hashes) and any(got)
    order = np.argsort(found.own, kind="stable")  # sorted as a suffix array is, host by host
    words = [(pages[p][0], pages[p][1][b][2].split(" ")[k : k + html_main.SPAN]) for p, b, k in found.at[order].tolist()]
    assert words == sorted(words)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_html(spark, monkeypatch, limit):
    monkeypatch.setattr(html_main, "BROADCAST_SUFFIXES", limit)
    menu = "Home News Sport Weather Culture Travel Food Science Arts Money Jobs"
    rows = [(i, f"https://h.example.com/{i}", f"<div>{menu}</div><ul><li>Top</ul><p>story number {i} {'word ' * i}</p><p>Top</p>") for i in range(3)]
    rows += [(9, "https://other.example.com/", f"<div>{menu}</div><p>lone</p>"), (10, "https://h.example.com/x", None), (11, None, "<article><p>a</p></article>"), (0, *rows[0][1:])]
    shared = "<article><p>" + "the same passage " * 20 + "</p></article>"
    rows += [(20, "https://h.example.com/20", f"<nav>{menu} lone</nav>{shared}"), (21, "https://h.example.com/21", shared + f"<div>{menu}</div>")]
    rows += [(30, "https://H.example.com/30", "<!-- <article> --><p>" + "own text " * 60_000 + f"</p><div>{menu}</div>"), (None, "", ""), (None, "", "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, n_chars int")
    got = Counter(tuple(r) for r in html_main.main_text(df).collect())
    text = {i: f"story number {i} {'word ' * i}".strip() + " Top" for i in range(3)} | {9: f"{menu} lone", 10: "", 11: "a", 20: ("the same passage " * 20).strip(), 30: ("own text " * 60_000).strip(), None: ""}
    text[21] = text[20]
    repeated, named = {0: 12, 1: 12, 2: 12, 20: 11, 21: 11, 30: 11}, {20: 1}
    assert got == Counter((r[0], r[1], text[r[0]], len(text[r[0]]), repeated.get(r[0], 0), named.get(r[0], 0)) for r in rows)
    assert html_main.main_text(df.limit(0)).count() == 0


# the queries and the pipeline


def test_queries_on_the_smallest_tables(spark):
    import os

    import duckdb

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, data)
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(want), name


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_on_odd_tables(spark, tmp_path, stage):
    """Null keys, repeated rows, null, empty and long texts, clashing names, and an empty table."""
    import corpus_pipeline

    _, labels = toxic_tables(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, "a b c d", "en", None), (None, "a b c d", "en", None), (1, None, None, "s"), (2, "", "en", "s"), (3, LONG, "en", "s"), (3, LONG, "en", "s"), (4, LONG[:5000] + " end", "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS first", "3 AS fp", "4 AS mix_pass", "5 AS token_ids", "6 AS __score", "7 AS `k.x`")
    name, step = corpus_pipeline.STAGES[stage]
    out = step(spark, docs, str(tmp_path))
    got = out.collect()
    if stage < 3:
        assert out.columns == docs.columns and all(tuple(r)[4:] == (1, 2, 3, 4, 5, 6, 7) for r in got)
    want = {0: 7, 1: 4, 3: 7}.get(stage)
    assert len(got) == want if want else {tuple(r)[:4] for r in got} == set(rows)
    assert stage < 3 or (all(r["round_trip"] for r in got) and Counter(r["doc_id"] for r in got)[None] == 2)
    nothing = step(spark, docs.limit(0), str(tmp_path))
    assert nothing.columns == out.columns and nothing.count() == 0


def test_operators_leave_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    bpe.digests(documents(spark, ["a", LONG])).collect()
    assert spark.conf.get(key) == before
    try:
        for given, want in (("64m", str(1 << 20)), ("1m", "1m")):
            spark.conf.set(key, given)
            small_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_slices_keep_all_rows(size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7) for i in range(50)])], names=["a", "b"])
    parts = list(slices(batch, size))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= size for p in parts) and list(slices(batch.slice(0, 0))) == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_tables(spark)
    docs = docs.selectExpr("doc_id", "CASE WHEN doc_id % 7 = 3 AND doc_id > 10 THEN 'the same clean text over and over' WHEN doc_id % 100 = 99 THEN NULL ELSE text END AS text", "'en' AS lang", "CASE WHEN doc_id % 3 > 0 THEN 's0' ELSE 's1' END AS source", "doc_id AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = docs.collect()
    lexicon = toxicity.fit(docs, labels)
    clean = [r for r in rows if lexicon.score(r["text"] or "") < 0.5]
    fps = [brute_fingerprint(r["text"] or "") for r in clean]
    hit = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 3
    comp = forest(*np.nonzero(hit), len(fps))
    order = [r["doc_id"] for r in clean]
    low = {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, 1 << 60), order[i])
    assert {r["doc_id"] for r in out} == set(low.values())
    assert all(r["round_trip"] for r in out)
    own = bpe.codec(bpe.default_path(), bpe.default_pattern())
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    assert all(bytes(r["token_ids"]) == own.encode(texts[r["doc_id"]]) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "source_mixing", "byte_level_bpe"]
