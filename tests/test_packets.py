"""Each code in a fixture written by hand, and the bounds of inflating."""

import base64
import gzip
import hashlib
import json

from deskloom.sources import packets


def encode(body):
    return base64.b64encode(gzip.compress(body.encode())).decode()


def articles():
    out = []
    for i in range(10):
        text = "\n".join(f"Line {j} of article {i} tells of a change." for j in range(20))
        out.append({"id": f"A{i + 1:02d}", "desk": packets.DESKS[i % 4], "title": f"Title {i}", "url": f"https://a.example.com/{i}", "publisherKey": "a", "sourceText": text, "sourceSha256": hashlib.sha256(text.encode()).hexdigest(), "captureNote": "whole"})
    return out


def with_text(text):
    return {"sourceText": text, "sourceSha256": hashlib.sha256(text.encode()).hexdigest()}


def test_inflated():
    assert packets.inflated(encode("déjà")) == "déjà"
    two = base64.b64encode(gzip.compress(b"a") + gzip.compress(b"b")).decode()
    assert packets.inflated(two) == "ab"
    assert packets.inflated(encode("x" * 180_000)) == "x" * 180_000
    bad = [None, "", "====", "YQ==", encode("x" * 180_001), encode("x" * 50_000_000), encode("abc")[:-8], encode("abc") + "\n", base64.b64encode(gzip.compress(b"a") + b"rest").decode(), "é"]
    assert [packets.inflated(b) for b in bad] == [None] * len(bad)
    assert packets.inflated("H4sIAAAAAAAAAwMAAAAAAAAAAAB=") is None  # bits beyond the last octet


def test_check_packets(spark):
    def body(i=None, change=None, count=10, **top):
        rows = articles()[:count]
        if i is not None:
            rows[i] = {k: v for k, v in {**rows[i], **change}.items() if v is not ...}
        return json.dumps({"version": 1, "articles": rows, **top})

    block = "word " * 1_300
    cases = [
        (body(), None), (body(version=1.0), None), (body(version=2), "BENCHMARK_PACKET"), (body(version="1"), "BENCHMARK_PACKET"), (body(more=1), "BENCHMARK_PACKET"), (body(count=9), "BENCHMARK_PACKET"), (body(articles={}), "BENCHMARK_PACKET"),
        ("[]", "BENCHMARK_PACKET"), ("null", "BENCHMARK_PACKET"), ("{", "BENCHMARK_PACKET"), ("", "BENCHMARK_PACKET"),
        (body(2, {"id": "A01"}), "BENCHMARK_ARTICLE"), (body(2, {"desk": "Other"}), "BENCHMARK_ARTICLE"), (body(2, {"title": " t"}), "BENCHMARK_ARTICLE"), (body(2, {"title": "t" * 251}), "BENCHMARK_ARTICLE"), (body(2, {"title": "a​b"}), "BENCHMARK_ARTICLE"),
        (body(2, {"title": 5}), "BENCHMARK_ARTICLE"), (body(2, {"title": None}), "BENCHMARK_ARTICLE"), (body(2, {"captureNote": ...}), "BENCHMARK_ARTICLE"), (body(2, {"more": "x"}), "BENCHMARK_ARTICLE"), (body(2, {"captureNote": ""}), "BENCHMARK_ARTICLE"),
        (body(2, with_text("short")), "BENCHMARK_ARTICLE"), (body(2, with_text("x" * 18_001)), "BENCHMARK_ARTICLE"), (body(2, {"sourceSha256": "0" * 64}), "BENCHMARK_ARTICLE"),
        (body(2, {"url": "https://a.example.com/1"}), "BENCHMARK_SOURCE"), (body(2, {"url": "https://b.example.com/2"}), "BENCHMARK_SOURCE"), (body(2, {"url": "http://a.example.com/2"}), "BENCHMARK_SOURCE"), (body(2, {"publisherKey": "b"}), "BENCHMARK_SOURCE"),
        (body(2, with_text("line of words\n" * 60)), "BENCHMARK_PASSAGES"), (body(2, with_text("\n".join(["five5"] * 129))), "BENCHMARK_PASSAGES"), (body(2, with_text(block.strip())), "BENCHMARK_PASSAGES"),
        (body(0, {"desk": packets.DESKS[1]}), None), (body(2, {"desk": packets.DESKS[1]}), "BENCHMARK_COVERAGE"),
    ]
    rows = [(i, encode(b), hashlib.sha256(b.encode()).hexdigest(), "clash") for i, (b, _) in enumerate(cases)]
    good, digest = rows[0][1], rows[0][2]
    broken = [(None, digest), (good, None), (good, digest.upper()), ("*" + good, digest), (good[:-4], digest), ("A" * 48_001, digest)]
    want = [c for _, c in cases] + ["BENCHMARK_PACKET"] * len(broken) + ["BENCHMARK_PACKET_HASH"]
    rows += [(len(cases) + i, e, s, "clash") for i, (e, s) in enumerate([*broken, (good, "0" * 64)])]
    df = spark.createDataFrame(rows, "packet int, encoded string, sha256 string, url string")
    known = spark.createDataFrame([("a", "a.example.com"), ("a", "A.example.com"), ("c", "c.example.com")], "publisher_key string, host string")
    got = {r["packet"]: (r["code"], r["articles"]) for r in packets.check_packets(df, known).collect()}
    assert [got[i] for i in range(len(want))] == [(c, 0 if c else 10) for c in want]
    assert packets.check_packets(df.limit(0), known).count() == 0
    assert [r["encoded"] for r in df.where("packet = 0").select(packets.unpacked("encoded").alias("encoded")).collect()] == [cases[0][0]]


def test_long_bodies(spark):
    """Without a bound a packet's long text is a fault of its article; with it the packet is none."""
    rows = articles()
    rows[3] |= with_text("words of a line\n" * 12_000)
    body = json.dumps({"version": 1, "articles": rows})
    assert packets.inflated(encode(body)) is None
    assert packets.inflated(encode(body), None) == body
    df = spark.createDataFrame([(1, encode(body), hashlib.sha256(body.encode()).hexdigest())], "packet int, encoded string, sha256 string")
    known = spark.createDataFrame([("a", "a.example.com")], "publisher_key string, host string")
    codes = [packets.check_packets(df, known, *bounds).first()["code"] for bounds in ((), (None, None))]
    assert codes == ["BENCHMARK_PACKET", "BENCHMARK_ARTICLE"]
