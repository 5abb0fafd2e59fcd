"""Operators 11 to 13 against plain versions of their definitions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deskloom.llm import fim, line_dedup, repair

BLANKS = " \t\n\x0b\x0c\r"


# conversation repair


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code:
            x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
            out += [(c, t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    return out


def mended(rows):
    """The facts of one conversation after damage, by a search for the cheapest edits, least letters first."""
    rows = sorted(rows, key=lambda y: ((0, 0) if y[1] is None else (1, y[1]), y[2].encode(), y[3].encode()))
    turns = [y[1] for y in rows if y[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, r, x in rows:
        body = x.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    initials = [y[2][:1] for y in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    done, heap, after = set(), [(0, "", 0, 0, ())], {0: "su", 1: "u", 2: "a", 3: "u"}
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        for letter in after[state]:
            then, role = " sua".index(letter), {"u": "user", "a": "assistant"}.get(letter)
            if role:
                heapq.heappush(heap, (cost + 2, audit + "I", i, then, (*out, (role, ""))))
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if role:
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, then, (*out, (role, rows[i][3]))))
                if initials[i] == letter:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, then, (*out, rows[i][2:])))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), out


@pytest.mark.parametrize(("chunk", "fold"), [(512, 16), (4, 3)])
def test_repair(spark, monkeypatch, chunk, fold):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FOLD", fold)
    rng = random.Random(3)
    rows = []
    for c in [*range(150), None]:
        for k in range(rng.choice([1, 1, 2, 3, 5, 8, 20])):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "", "tool", None, "uncle"])
            rows.append((c, rng.choice([k, k, k, None, 0]), role, rng.choice(["ok.", "ok", "no!\t", "", " ", None, "é?", f"x.{k}"])))
    rows += [(1000, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"b{k}.", f"c{k}"])) for k in range(60)]
    rows += [(1001, 0, "user", "long " * 200_000 + "."), (1001, 1, "assistant", "x.")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.damaged_and_repaired(df).collect()}
    want = {c: mended(damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == {c: w[:-1] for c, w in want.items()}
    flagged = repair.faults(repair.damaged(df))
    turns = repair.repaired(flagged, df).orderBy("conv_id", "place").collect()
    for c, w in want.items():
        mine = [r for r in turns if r["conv_id"] == c]
        assert [(r["role"], r["text"]) for r in mine] == list(w[-1])
        assert "".join(r["edit"] for r in mine) == w[-3].replace("D", "")
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_a_conversation_of_many_chunks(spark):
    rows = [(1, k, ("user", "assistant")[(k + k // 700) % 2], f"t{k}.") for k in range(9_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.digests(repair.faults(df), df).collect()[0]
    want = mended(rows)
    assert tuple(got)[1:] == want[:-1] and got["illegal"] == 12


# line dedup


def key(line):
    return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})


def kept(texts, documents, least):
    texts = [x or "" for x in texts]
    found = Counter(k for x in texts for k in {key(line) for line in x.split("\n")} if len(k) >= least)
    frequent = {k for k, n in found.items() if n >= documents}
    return [[line for line in x.split("\n") if key(line) not in frequent] for x in texts]


@pytest.mark.parametrize(("parts", "documents", "least"), [(1, 3, 1), (7, 3, 1), (3, 2, 4), (6, 1, 0)])
def test_lines(spark, parts, documents, least):
    rng = random.Random(parts)
    words = ["A", " a", "a\t", "É", "é", "long line", "Long Line ", "", " ", " x", "x\r", "tail\x85", "I", "İ"]
    texts = ["\n".join(rng.choice([*words, f"own {i}"]) for _ in range(rng.randrange(6))) for i in range(60)]
    texts += [None, "", "\n", "\n\n", "same\nsame", "same", "word " * 100_000 + "\n" + "y\n" * 50_000]
    rows = [(i % 50, x, i, "q") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, k string")
    pieces = [df.where(f"a % {parts} = {i}") for i in range(parts)]
    got = {r["a"]: (r["doc_id"], r["k"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(pieces, documents=documents, least=least).collect()}
    for (i, x, a, k), lines in zip(rows, kept(texts, documents, least), strict=True):
        n = len((x or "").split("\n"))
        assert got[a] == (i, k, "\n".join(lines), n, n - len(lines))
    assert line_dedup.dedup([df.limit(0)]).count() == 0 and line_dedup.dedup([df.limit(0), df.limit(0)]).count() == 0


def test_runs_are_levelled_and_gone_in_the_end(spark):
    runs = line_dedup.LineRuns(spark, documents=3, fanout=2)
    one = spark.createDataFrame([("x\ny",), ("x",)], "text string")
    for i in range(5):
        runs.add(one if i < 4 else one.limit(0))
        assert [len(level) for level in runs.levels] == {0: [1], 1: [0, 1], 2: [1, 1], 3: [0, 0, 1], 4: [1, 0, 1]}[i]
    whole = runs._sum([r for level in runs.levels for r in level]).collect()
    assert sorted(r["n"] for r in whole) == [4, 4]  # x was left out once two batches had shown it in four rows
    assert runs.frequent().df.count() == 2
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_batches_read_each_file_once(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "concat('same\n', id) AS text").repartition(11).write.parquet(f"{tmp_path}/d.parquet")
    df = spark.read.parquet(f"{tmp_path}/d.parquet")
    parts = line_dedup.batches(df, 4)
    assert len(parts) == 4 and sorted(r[0] for p in parts for r in p.select("doc_id").collect()) == list(range(100))
    got = line_dedup.digests(df).collect()
    assert len(got) == 100 and all(r["kept_sha256"] == hashlib.sha256(str(r["doc_id"]).encode()).hexdigest() for r in got)


# fill in the middle


def infilled(i, text, fim_percent=100, spm_percent=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return h, (len(lines), "plain", None, None, text)
    if h[3] % 100 < spm_percent:
        return h, (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return h, (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_the_kernel():
    rng = random.Random(1)
    for _ in range(300):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice("a\n\né<PSM>🎉") for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.choice([1, 2, 30]))]
        want = [infilled(i, x) for i, x in enumerate(texts)]
        got = fim.cut(pa.array(["zz", *texts], pa.string()).slice(1), np.array([h for h, _ in want]), 100, 50)
        assert list(zip(*[c.to_pylist() for c in got], strict=True)) == [w for _, w in want]
        assert fim.rebuilt(got[4], got[1]).to_pylist() == [x or "" for x in texts]


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (60, 20)])
def test_fill_in_middle(spark, percent, spm):
    texts = ["", None, "one", "one\n", "a\nb\nc\n", "\n\n\n", "é\r\n x\ny", "has <P> in\nit", "<P", ">", "M>\n<S>", "line\n" * 100_000, "w" * 3_000_000] + ["x\ny\nz"] * 40
    rows = [(i if i % 9 else None, x, i, 0) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, output int")
    out = fim.restore(fim.fill_in_middle(df.select("doc_id", "text", "n", "output"), fim_percent=percent, spm_percent=spm))
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter((i, *infilled(i, x, percent, spm)[1], x or "") for i, x, _, _ in rows)
    assert fim.digests(df.limit(0)).count() == 0
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
