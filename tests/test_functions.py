"""Functions on small cases, with what Python's own libraries say where they can."""

import hashlib
import hmac
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from deskloom import plans
from deskloom.checkpoints import checkpointed
from deskloom.functions import events, numbers, prose, roles, scoring, text, times
from deskloom.functions import values as V
from deskloom.operators import ledger, matching, ranking
from deskloom.operators.editorial import edition_issues, newsroom_issues
from deskloom.sources import editions, feeds, pages
from deskloom.streaming import intake


def value(spark, column, **given):
    rows = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<![CDATA[<b>A</b> &amp; B]]>", "A & B"),
        ("x &#233;&#x1F600; y", "x é😀 y"),
        ("a<script>1 < 2</script>b", "a b"),
        ("  a b \n c ", "a b c"),
        ("&lt;b&gt;t", "t"),
        ("&#0;&#55296;&#99999999;k", "k"),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert value(spark, text.clean_text(F.col("x")), x=raw) == want


def cleaned(raw):
    """T01 step by step, in the reference's order."""
    point = lambda n: chr(n) if 0 < n < 0x110000 and not 0xD800 <= n <= 0xDFFF else ""
    x = re.sub(r"(?is)<!\[CDATA\[(.*?)\]\]>", r"\1", raw)
    x = re.sub(r"&#(\d+);", lambda m: point(int(m[1])), x)
    x = re.sub(r"(?i)&#x([0-9a-f]+);", lambda m: point(int(m[1], 16)), x)
    for name, put in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        x = re.sub(f"(?i)&{name};", put, x)
    for tag in ("script", "style"):
        x = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ", x)
    x = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", re.sub("<[^>]+>", " ", x))
    return re.sub(r"\s+", " ", x).strip()


def test_clean_text_of_raw_pages(spark, tmp_path):
    """The query decodes the references itself; none comes back as a mask."""
    html = [
        '<head><title>A &amp; B</title><script>var t="</p>";</script><style>p{margin:0}</style></head><p>&quot;x&quot; &copy; y &middot; z&nbsp;w',
        "&lt;script&gt;track(1)&lt;/script&gt;kept &amp;lt;b&amp;gt; &#233;&#x1F600; 1 &lt; 2 &gt; 0",
        "<![CDATA[<b>R&amp;D</b>]]> it&apos;s &AMP; <STYLE>a</STYLE >done",
    ]
    spark.createDataFrame(list(enumerate(html)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in plans.QUERIES["t01_clean_text_raw"](spark, str(tmp_path)).collect()}
    assert got == {i: cleaned(x) for i, x in enumerate(html)}
    assert got[0] == 'A & B "x" &copy; y &middot; z w'


def test_clean_text_cuts(spark):
    assert len(value(spark, text.clean_text(F.col("x"), 240), x="ab " * 3000)) == 240


def test_nfkc(spark):
    raw = "ﬁne‐Ⅷ é − x"
    want = unicodedata.normalize("NFKC", raw).replace("‐", "-").replace("−", "-")
    assert value(spark, text.nfkc(F.col("x")), x=raw) == want


def test_tokens_and_stems(spark):
    got = value(spark, text.title_tokens(F.col("x")), x="Node.js 2026: companies cut jobs, a zero-day in chips; status bus")
    assert got == sorted({"nodej", "company", "cut", "jobs", "zero-day", "chip", "status", "bus"})
    got = value(spark, text.event_tokens(F.col("x")), x="Node.js 2026: companies cut jobs, a zero-day in state-of-the-art chips; AI study")
    assert got == sorted({"nodej", "jobs", "zero-day", "state-of-the-art", "state", "of", "the", "art", "chip"})


def test_terms_and_inflections(spark):
    assert value(spark, text.has_term(F.col("x"), "zero-day"), x="a zero day bug")
    assert value(spark, text.has_term(F.col("x"), "launch"), x="it launched")
    assert not value(spark, text.has_term(F.col("x"), "ai"), x="they said main")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-03-08T05:00:00Z", "2026-03-08 05:00:00"),
        ("2026-03-08T05:00:00+02:00", "2026-03-08 03:00:00"),
        ("Mon, 5 Jan 2026 05:00:00 GMT", "2026-01-05 05:00:00"),
        ("05 Jan 49 05:00 -0500", "2049-01-05 10:00:00"),
        ("05 Jan 50 05:00:00 UTC", "1950-01-05 05:00:00"),
        ("2026-03-08", None),
        ("2026-03-08T05:00:00", None),
        ("soon", None),
    ],
)
def test_instants(spark, raw, want):
    got = value(spark, times.parse_instant(F.col("x")).cast("string"), x=raw)
    assert got == want


def test_strict_instants_do_not_roll_over(spark):
    assert value(spark, times.strict_instant(F.col("x")), x="2026-02-30T05:00:00Z") is None
    assert value(spark, times.strict_instant(F.col("x")), x="2026-02-28T05:00:00+15:00") is None
    assert value(spark, times.real_date(F.col("x")), x="2026-02-29") is None


@pytest.mark.parametrize(("day", "hours"), [("2026-03-08", 23), ("2026-11-01", 25), ("2026-07-01", 24)])
def test_days_of_clock_changes(spark, day, hours):
    end = times.local_instant(F.col("d"), "05:00")
    length = (F.unix_seconds(end) - F.unix_seconds(times.window_start(end))) / 3600
    assert value(spark, length, d=day) == hours


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert value(spark, text.hmac_sha256(key, F.col("m")), m="grüße") == hmac.new(key, "grüße".encode(), hashlib.sha256).hexdigest()


def test_urls(spark):
    assert value(spark, text.canonical_url(F.col("u")), u="http://A.example.com/p?b=2&utm_source=x&a=1#t") == "https://a.example.com/p?a=1&b=2"
    assert value(spark, text.canonical_url(F.col("u")), u="ftp://a/") is None
    assert value(spark, text.url_allowed(F.col("u"), ["a.example.com"]), u="https://a.example.com:443/x")
    for bad in ("http://a.example.com/", "https://u@a.example.com/", "https://a.example.com:8443/", "https://b.example.com/"):
        assert not value(spark, text.url_allowed(F.col("u"), ["a.example.com"]), u=bad)


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("10.1.1.1", False), ("172.32.0.1", True), ("198.19.1.1", False), ("256.1.1.1", False), ("2606:4700::1", True), ("fe80::1", False), ("2001:db8::1", False), ("x", False)])
def test_public_addresses(spark, address, public):
    assert value(spark, numbers.public_address(F.col("a")), a=address) is public


def test_anchors(spark):
    got = value(spark, numbers.anchors(F.col("t")), t="$1.5 billion and €2,000, 12% off, 300 jobs, 25 basis points, 0.0005 dollars")
    assert got == ["basis-point=25", "currency-eur=2000", "currency-usd=0.0005:1", "currency-usd=1500000000", "headcount=300", "percent=12"]
    conflict = numbers.anchors_conflict(numbers.anchors(F.col("a")), numbers.anchors(F.col("b")))
    assert value(spark, conflict, a="pays $5 million", b="pays $6 million")
    assert not value(spark, conflict, a="pays $5 million", b="pays 5 million dollars")


def test_prose(spark):
    codes = lambda x: value(spark, prose.prose_codes(F.col("x"), True), x=x)
    assert codes("All is well.") == []
    assert codes('{"headline": "x"}')[0] == "READER_PROSE_SCHEMA_FRAGMENT"
    assert "READER_PROSE_INCOMPLETE" in codes("it goes on")
    assert codes("It stops because.") == ["READER_PROSE_DANGLING_ENDING"]
    assert codes(" ") == ["READER_PROSE_EMPTY"]
    assert value(spark, prose.unsupported_names(F.col("o"), F.col("s")), o="The firm Acme met Zed.", s="acme grew") == ["zed"]
    assert value(spark, prose.unsupported_names(F.col("o"), F.col("s")), o="Exploited zero-day hits iPhone. This Acme firm Read more.", s="acme grew") == ["exploited", "iphone", "zero-day"]


def test_passages_skip_what_does_not_fit():
    blocks = ["a" * 60 + " start", "b" * 500, "Users must patch before use of the thing", "c" * 30]
    assert prose.select_passages(blocks, "", 150) == [blocks[0], blocks[2], blocks[3]]


def test_passages_keep_what_the_whole_budget_holds(spark, tmp_path):
    """By default 5,800 characters and 40 passages, line ends counted; one character or passage more does not fit."""
    full = [f"{i:04d} " + "x" * 135 for i in range(40)]
    short = [f"{i:04d} " + "y" * 30 for i in range(41)]
    exact = ["a" * 2900, "b" * 2899]
    texts = ["\n".join(x) for x in (full, short, exact, ["a" * 2900, "b" * 2900])]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id int, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["passages"]) for r in plans.QUERIES["t19_passage_selection"](spark, str(tmp_path)).collect()}
    assert got == {0: (40, texts[0]), 1: (40, "\n".join(short[:40])), 2: (2, texts[2]), 3: (1, "a" * 2900)}


def test_version_bounds(spark):
    got = value(spark, prose.version_bounds(F.col("t")), t="no later than 1.2.3, before v2.0, and 3.1 or later; at least 4.5")
    assert got == ["gte:3.1", "gte:4.5", "lt:2.0", "lte:1.2.3"]
    assert value(spark, prose.bound_drift(F.col("a"), F.col("b")), a="before 2.0", b="up to and including 2.0") == ["lt:2.0"]


def test_edits(spark):
    edit = lambda find: value(spark, prose.apply_edit(F.col("t"), F.col("f"), F.lit("new")), t="one two three four five", f=find)
    assert edit("two") == "one new three four five"
    assert edit("tw") is None and edit("two three") is None and edit("x") is None


def test_vetoes(spark):
    def codes(title, summary="", category="news", borne=False):
        found = scoring.vetoes(F.col("t"), F.col("s"), F.array(F.col("c")), F.lit("/x"), F.lit(borne))
        return value(spark, found, t=title, s=summary, c=category)

    assert codes("Shopping guide for you") == ["PROMOTIONAL_OR_DEAL_CONTENT"]
    assert codes("Code review tool") == []
    assert codes("A rumor of a chip") == ["SPECULATIVE_OR_RUMOR"]
    assert codes("Firm reportedly buys") == ["SPECULATIVE_OR_RUMOR"] and codes("Firm reportedly buys", borne=True) == []
    assert codes("On it | Opinion") == ["OPINION_OR_COMMENTARY"]
    assert codes("Service now available in two regions") == ["ROUTINE_CLOUD_CAPACITY_NOTICE"]
    assert codes("Service now available in two regions", "a breach") == []


def test_desks(spark):
    def desk(title, summary=""):
        hits = [scoring.desk_hits(F.lower(c)) for c in ("t", "s")]
        return value(spark, scoring.choose_desk(scoring.desk_scores(*hits), F.col("t")), t=title, s=summary)

    assert desk("Ransomware breach") == "security-and-privacy"
    assert desk("Firm plans IPO of AI model maker") == "platforms-and-power"
    assert desk("Nothing here") is None


RSS = """<rss><channel><item><title>One</title><link>http://a.example.com/1?utm_x=1#f</link><pubDate>Mon, 05 Jan 2026 05:00:00 GMT</pubDate><description><![CDATA[<p>D</p>]]></description><category>x</category><category>x</category></item>
<item><title>No date</title><link>https://a.example.com/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>CVE-2026-12345</title><link rel="self" href="https://a.example.com/self"/><link rel="alternate" href="https://a.example.com/3"/><published>2026-01-05T05:00:00+01:00</published><updated>2025-01-05T05:00:00Z</updated><summary>S</summary><category term="t"/></entry></feed>"""


def test_feeds(spark):
    bodies = spark.createDataFrame([("r", RSS), ("a", ATOM)], "source_id string, body string")
    rows = {r["source_id"]: r for r in feeds.normalize(feeds.parse_xml(bodies)).collect()}
    assert len(rows) == 2
    assert (rows["r"]["url"], rows["r"]["summary"], rows["r"]["categories"]) == ("https://a.example.com/1", "D", ["x"])
    assert (rows["a"]["url"], rows["a"]["updated_at"], rows["a"]["categories"]) == ("https://a.example.com/3", None, ["t"])
    json = spark.createDataFrame([("j", '{"items":[{"external_url":"https://a.example.com/4","title":"J","content_html":"<b>x</b>","date_published":"2026-01-05T05:00:00Z"},{"title":"no zone","url":"https://a.example.com/5","date_published":"2026-01-05T05:00:00"}]}')], "source_id string, body string")
    assert [r["summary"] for r in feeds.normalize(feeds.parse_json(json)).collect()] == ["x"]


def test_fair_sample(spark):
    rows = [("a", i, i) for i in range(5)] + [("b", 10, 10), ("c", 20, 20)]
    df = spark.createDataFrame(rows, "s string, t int, i int")
    got = {(r["s"], r["i"]) for r in ranking.fair_sample(df, "s", [F.desc("t"), F.asc("i")], 4).collect()}
    assert got == {("a", 4), ("b", 10), ("c", 20), ("a", 3)}


def test_ledger(spark):
    old = spark.createDataFrame([("2026-01-01", "a"), ("2026-01-02", "b")], "day string, k string")
    for rows, n, wrong in (([("2026-01-02", "b")], 2, 0), ([("2026-01-02", "x")], 2, 1), ([("2025-12-31", "x")], 2, 1), ([("2026-01-03", "x")], 3, 0)):
        kept, conflicts = ledger.append(old, spark.createDataFrame(rows, "day string, k string"), "day", ["k"])
        assert (kept.count(), conflicts.count()) == (n, wrong)
    with pytest.raises(ValueError):
        ledger.derived_key(b"short", "d")


def test_complete_link_needs_all_members(spark):
    """b matches a and c, which do not match each other: a bridge must not join them."""
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "low string, high string")
    got = {r["item"]: r["group"] for r in matching.complete_link(items, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


#: Headlines with the role that they state.
STATED = [
    ("FTC accuses Meta of child privacy violations", "enforcer:ftc->meta"), ("FTC alleges Meta violated child privacy rules", "enforcer:ftc->meta"),
    ("Apple is sued by Google over App Store payment rules", "claimant:google->apple"), ("Apple sued by Google over App Store payment rules", "claimant:google->apple"),
    ("Antitrust lawsuit against Apple filed by Google over digital mobile payments", "claimant:google->apple"), ("Google lawsuit against Apple targets App Store payment rules", "claimant:google->apple"),
    ("Google's lawsuit against Apple targets App Store payment rules", "claimant:google->apple"), ("Google sues Acme over mobile privacy rules", "claimant:google->acme"),
    ("FTC takes legal action against Meta over child privacy", "claimant:ftc->meta"), ("Apple faces suit from Google over App Store payment rules", "claimant:google->apple"),
    ("Meta reaches $5 billion child privacy settlement with FTC", "settlement:ftc+meta"), ("Meta hit with $5 billion fine by FTC over child privacy violations", "enforcer:ftc->meta"),
    ("Meta fined $5 billion by FTC over child privacy violations", "enforcer:ftc->meta"), ("Meta receives a $5 billion FTC fine over child privacy violations", "enforcer:ftc->meta"),
    ("FTC levies a $5 billion penalty against Meta for child privacy violations", "enforcer:ftc->meta"), ("Court orders Apple to pay Google $1 billion", "payer:apple->google"),
    ("Google receives $1 billion from Apple after court award in digital marketplace case", "payer:apple->google"), ("Google wins $1 billion payment from Apple in court case", "payer:apple->google"),
    ("FTC fines Meta $5 billion over child privacy violations", "enforcer:ftc->meta"), ("Apple is beaten by Google in antitrust case", "winner:google->apple"),
    ("Apple secures court victory over Google in digital mobile payments case", "winner:apple->google"), ("Google prevails over Apple in antitrust case", "winner:google->apple"),
    ("Google wins antitrust case against Apple over App Store payments", "winner:google->apple"), ("Apple loses antitrust case to Google over App Store payment rules", "winner:google->apple"),
    ("Court sides with Google against Apple in antitrust case over App Store payments", "winner:google->apple"), ("Meta investigated by FTC over child privacy practices", "investigator:ftc->meta"),
    ("Meta under FTC investigation over child privacy practices", "investigator:ftc->meta"), ("Meta faces FTC probe over child privacy practices", "investigator:ftc->meta"),
    ("FTC opens inquiry into Meta child privacy practices", "investigator:ftc->meta"), ("FTC opens privacy probe into Meta advertising practices", "investigator:ftc->meta"),
    ("Apple agrees to merge with Acme AI after board approval", "merger:acme+apple"), ("Apple and Acme AI agree to merger after board approval", "merger:acme+apple"),
    ("Apple's Acme AI acquisition closes after regulatory review", "acquirer:apple->acme"), ("Acme AI bought by Apple after regulatory review", "acquirer:apple->acme"),
    ("Apple takes over Acme AI after regulatory review", "acquirer:apple->acme"), ("Apple makes $1 billion bid for Acme AI after review", "acquirer:apple->acme"),
    ("Apple confirms $1 billion acquisition of AI startup Acme", "acquirer:apple->acme"), ("VS Code acquired by Zed", "acquirer:zed->microsoft"), ("Facebook and Open AI reach settlement", "settlement:meta+openai"),
    ("Somebody fines Zed", None), ("Apple sues Apple", "claimant:apple->apple"), ("nothing", None), ("", None), (None, None),
]


def test_roles(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATED)], "i int, t string")
    got = {r["i"]: r["role"] for r in rows.select("i", roles.role_anchor(F.col("t")).alias("role")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(STATED)] == STATED


def test_mentions(spark):
    got = value(spark, roles.mentions(F.col("t")), t="Google Chrome’s é and Palo  Alto Networks meet VS Code, AWS")
    assert [tuple(m) for m in got] == [("google", 0, 13), ("palo-alto-networks", 22, 40), ("microsoft", 46, 53), ("amazon", 55, 58)]
    assert value(spark, roles.mentions(F.col("t")), t=None) == []


def test_equal_items_stand_for_each_other(spark):
    rows = [(1, "Rival firm opens giant data center site", "p", "u1"), (2, "Rival firm opens giant data center site", "p", "u2"), (3, "Rival firm opens giant data center site", "q", "u3"), (4, "other", "p", "u4")]
    items = matching.features(spark.createDataFrame(rows, "i int, t string, p string, u string"), "i", "t", "p", "u")
    got = {r["item"]: r["group"] for r in matching.group_events(items, ["title", "url", "item"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # another publisher's needs a known entity


def test_matches(spark):
    rows = [
        (1, "Acme patches CVE-2026-11111 hole", "p", "u1"), (2, "Hole CVE-2026-11111 closed by Acme", "q", "u2"), (3, "Acme patches CVE-2026-22222 hole", "r", "u3"),
        (4, "Rival firm opens giant data center site", "p", "u4"), (5, "Rival firm opens giant data center campus", "q", "u5"), (6, "Rival firm denies giant data center campus", "r", "u6"),
    ]
    items = matching.features(spark.createDataFrame(rows, "i int, t string, p string, u string"), "i", "t", "p", "u")
    assert {tuple(r) for r in matching.matching_pairs(items).collect()} == {(1, 2)}  # (4, 5) share no known entity


@pytest.mark.parametrize(
    ("tag", "title", "want"),
    [
        ("actions", "Acme network is down", ["outage"]), ("actions", "Acme to cut 50 jobs", ["layoff"]), ("actions", "Acme hires staff", ["hiring"]), ("actions", "Acme probe opens", ["investigation"]),
        ("actions", "Acme raises API prices", ["pricing-increase"]), ("actions", "Acme retires phone", ["termination"]), ("artifacts", "Acme model card", ["safety-artifact"]), ("objects", "Study mode for apps", ["app"]),
        ("objects", "Acme plans an update", ["update"]), ("lifecycle", "Acme lawsuit dismissed; judge tosses out case", ["dismissed"]), ("facets", "Acme data retention pricing", ["retention", "pricing"]),
        ("stage", "Acme completes Zed deal", "completed"), ("stage", "Acme announces phone", None), ("entities", "Visual  Studio Code and AWS", ["microsoft", "amazon"]), ("stage", None, None), ("objects", None, []),
        ("products", "GPT-5 mini in ChatGPT API on Windows 11 24H2 for SMB", ["acronym:smb-sme", "channel:api", "channel:chatgpt", "channel:windows-servicing:24h2", "model:gpt-5-mini", "named:chatgpt", "named:windows", "version:windows:11"]),
    ],
)
def test_event_tags(spark, tag, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(getattr(events, tag)(F.col("t")).alias("v")).first()["v"] == want


#: Headlines of two publishers that tell one event, and such that do not, for each kind of rule.
ONE_EVENT = [
    ("OpenAI launches GPT‑5", "OpenAI GPT-5 is now generally available"),
    ("Google launches quantum error correction milestone", "Google quantum error correction milestone detailed"),
    ("Google launches quantum error-correction AI decoder breakthrough", "Google releases quantum error correction AI decoder breakthrough"),
    ("Google launches quantum error correction app", "Google releases quantum error correction application"),
    ("Anthropic launches Claude Code in the browser for developers", "Claude Code is now available in browsers for developers"),
    ("AWS cuts Glue prices by 30%", "AWS Glue is now 30 percent cheaper"),
    ("Microsoft lays off 500 employees in Azure DevOps division", "Microsoft eliminates 500 roles from its Azure DevOps unit"),
    ("Google releases a Chrome WebRTC security patch", "Google patches Chrome WebRTC"),
    ("GitHub launches Copilot coding agent for pull requests", "Microsoft launches Copilot coding agent for pull requests"),
    ("Anthropic rolls out Claude memory for paid users", "Claude can remember past chats"),
    ("AWS Glue prices down 30 percent", "AWS cuts Glue prices by 30%"),
    ("Apple acquires Acme AI for $1 billion", "Apple confirms $1 billion acquisition of AI startup Acme"),
    ("Apple takes over Acme AI after regulatory review", "Apple acquires Acme AI after regulatory review"),
    ("Apple's Acme AI acquisition closes after regulatory review", "Apple buys Acme AI after regulatory review"),
    ("OpenAI debuts GPT-5.4 API for enterprise developers", "GPT-5.4 API goes live for enterprise developers"),
    ("FTC fines Meta $5 billion over child privacy violations", "Meta is fined $5 billion by FTC over child privacy violations"),
    ("FTC fines Meta $5 billion over child privacy violations", "Meta hit with $5 billion fine by FTC over child privacy violations"),
    ("Court orders Apple to pay Google $1 billion in digital marketplace case", "Google receives $1 billion from Apple after court award in digital marketplace case"),
    ("Google restores Workspace service after global authentication outage", "Google Workspace service returns to normal after global authentication outage"),
    ("Google Workspace authentication outage is resolved", "Google Workspace service is fully operational after authentication outage"),
    ("Google sues Apple over App Store payment rules", "Apple faces suit from Google over App Store payment rules"),
    ("Google sues Apple over App Store payment rules", "Google's lawsuit against Apple targets App Store payment rules"),
    ("FTC investigates Meta over child privacy practices", "FTC opens inquiry into Meta child privacy practices"),
    ("FTC settles child privacy case with Meta for $5 billion", "Meta reaches $5 billion child privacy settlement with FTC"),
    ("Apple and Acme AI agree to merger after board approval", "Apple agrees to merge with Acme AI after board approval"),
    ("Google launches AI workflow tools for SMB teams", "Google launches AI workflow tools for SME teams"),
    ("Google sues Apple over App Store payment rules", "Google sues Apple over App Store billing rules"),
    ("Google wins antitrust case against Apple over App Store payments", "Apple loses antitrust case to Google over App Store payment rules"),
    ("PaperCut NG/MF flaw exploited in 0-day attacks", "PaperCut under 0-day attack"),
    ("Anthropic was illegally blacklisted by the Trump administration, court rules", "Pentagon’s blacklisting of Anthropic was unlawful, US judge rules"),
    ("TikTok will pay $400 million in child privacy settlement", "TikTok hit with $400M settlement over children's privacy"),
    ("Apple is reportedly cutting hundreds of jobs from Siri, Vision Pro teams", "Apple is laying off staffers working on the Vision Pro and Siri"),
    ("OpenAI introduces GPT-5.4", "GPT-5.4 is OpenAI's new flagship model"),
]
TWO_EVENTS = [
    ("Google launches new AI model for developers with faster inference", "Microsoft launches new AI model for developers with safer training"),
    ("Apple cuts Vision Pro jobs after weak headset sales", "Apple patches critical WebKit zero day affecting iPhone users"),
    ("Amazon Corretto August 2026 Critical Security Patch Updates", "Oracle August 2026 Critical Security Patch Update Addresses 925 CVEs"),
    ("PaperCut NG/MF flaw exploited in zero-day attacks", "PaperCut Mobility Print flaw exploited in zero-day attacks"),
    ("PaperCut NG/MF authentication service flaw exploited in zero-day attacks", "PaperCut NG/MF print spooler flaw exploited in zero-day attacks"),
    ("Pentagon cloud-procurement blacklisting of Anthropic was illegal, court rules", "Pentagon defense-contract blacklisting of Anthropic was unlawful, judge rules"),
    ("Google faces antitrust ruling over search advertising practices", "Google loses antitrust court fight over Android app store billing"),
    ("OpenAI ChatGPT outage disrupts paid users worldwide", "OpenAI launches ChatGPT team collaboration features"),
    ("Google launches quantum error correction API", "Google launches quantum error correction API extension"),
    ("Google launches quantum error correction model", "Google releases quantum error correction dataset"),
    ("Google prevails over Apple in antitrust case over App Store payments", "Apple prevails over Google in antitrust case over App Store payments"),
    ("Apple acquires Acme AI for $1 billion", "Apple acquires Acme AI for £2 billion"),
    ("Microsoft lays off 500 posts in Azure DevOps", "Microsoft lays off 1,000 posts in Azure DevOps"),
    ("FTC blocks Apple acquisition of Acme AI", "FTC approves Apple acquisition of Acme AI"),
    ("Court dismisses Google antitrust lawsuit against Apple", "Google files antitrust lawsuit against Apple"),
    ("Microsoft Azure cloud market share rises 10% in enterprise computing", "Microsoft Azure cloud market share rises 10 percentage points in enterprise computing"),
    ("Court orders Apple to pay Google $1 billion in app marketplace case", "Court orders Google to pay Apple $1 billion in app marketplace case"),
    ("OpenAI nixes GPT-5.4 rollout in Europe for enterprise customers", "OpenAI launches GPT-5.4 in Europe for enterprise customers"),
    ("Google files antitrust lawsuit against Apple over mobile advertising controls", "Google settles antitrust lawsuit with Apple over mobile advertising controls"),
    ("Apple submits $1 billion bid for Acme AI after board approval", "Apple submits $1 billion bid for Beta AI after board approval"),
    ("Microsoft lays off five hundred Azure DevOps workers in Europe", "Microsoft lays off one thousand Azure DevOps workers in Europe"),
    ("Google sues Apple over search advertising restrictions", "Google sues Apple over display advertising restrictions"),
    ("Google sues Apple in antitrust lawsuit over teen payment safeguards", "Google sues Apple in antitrust lawsuit over teen privacy safeguards"),
    ("AWS cuts ECS cloud compute prices by 30% for enterprise workloads", "AWS cuts EKS cloud compute prices by 30% for enterprise workloads"),
    ("FTC opens privacy probe into Meta advertising practices", "FTC opens privacy probe into TikTok advertising practices"),
    ("Apple acquires Acme AI for one billion dollars", "Apple acquires Acme AI for two billion euros"),
    ("Google says patch for CVE-2026-9191 failed and users remain vulnerable", "Google patches CVE-2026-9191"),
    ("Apple makes $1 billion bid for Acme AI valued at $5 billion", "Apple makes $2 billion bid for Acme AI valued at $5 billion"),
    ("Microsoft cuts 500 of 5,000 Azure DevOps jobs", "Microsoft cuts 600 of 5,000 Azure DevOps jobs"),
    ("Apple and Meta agree to merger after board approval", "Apple and Meta complete merger after board approval"),
    ("Google sues Acme over mobile privacy rules", "Acme sues Google over mobile privacy rules"),
    ("Apple launches iOS 19.1 beta 1 privacy controls", "Apple launches iOS 19.1 beta 2 privacy controls"),
    ("Apple announces acquisition of Acme AI after review", "Apple completes acquisition of Acme AI after review"),
    ("FTC sanctions Meta over child privacy violations", "FTC sanctions TikTok over child privacy violations"),
    ("Rival firm opens giant data center site", "Rival firm opens giant data center campus"),
]


@pytest.fixture(scope="module")
def headline_pairs(spark):
    rows = [r for k, (a, b) in enumerate(ONE_EVENT + TWO_EVENTS) for r in ((2 * k, a, "p", f"u{k}a"), (2 * k + 1, b, "q", f"u{k}b"))]
    items = checkpointed(matching.features(spark.createDataFrame(rows, "i int, t string, p string, u string"), "i", "t", "p", "u"))
    return items, {tuple(r) for r in matching.matching_pairs(items).collect()}


def test_pairs_of_headlines(headline_pairs):
    found = headline_pairs[1]
    texts = ONE_EVENT + TWO_EVENTS
    assert [t for k, t in enumerate(texts) if ((2 * k, 2 * k + 1) in found) != (t in ONE_EVENT)] == []


@pytest.mark.parametrize("piece", [1_000, 2])
def test_blocks_miss_no_pair(spark, headline_pairs, monkeypatch, piece):
    monkeypatch.setattr(matching, "PIECE", piece)
    items, found = headline_pairs
    a, b = items.alias("a"), items.alias("b")
    every = a.crossJoin(b).where(F.col("a.item") < F.col("b.item")).where(matching.pair_predicate()).select("a.item", "b.item")
    assert {tuple(r) for r in every.collect()} == found
    pairs = matching.block_pairs(checkpointed(matching._blocks(items)), piece)
    assert {tuple(r) for r in pairs.collect()} >= found


def test_pairs_by_summaries_and_origins(spark):
    rows = [
        (0, "Chrome patches exploited WebRTC zero-day", "p", "u0", "The release fixes CVE-2026-1111 and the exploited WebRTC issue CVE-2026-9999.", None),
        (1, "Google closes exploited WebRTC flaw in Chrome", "q", "u1", "The bulletin lists CVE-2026-2222 before CVE-2026-9999.", None),
        (2, "Cisco patches router flaw CVE-2026-9090", "p", "u2", None, None), (3, "Cisco closes a router vulnerability in its security update", "q", "u3", "The security update remediates CVE-2026-9090.", None),
        (4, "Offering zero data retention for frontier models", "openai", "u4", None, "OpenAI"), (5, "OpenAI promises zero data retention for enterprise models", "q", "u5", None, None),
        (6, "Introducing ChatGPT for Teens: Built for learning, backed by protections", "openai", "u6", None, "OpenAI"), (7, "OpenAI makes ChatGPT less 'human' for teens in new safety update", "bbc", "u7", None, None),
        (8, "Open AI launches ChatGPT designed for younger users", "npr", "u8", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, t string, p string, u string, s string, o string")
    items = checkpointed(matching.features(df, "i", "t", "p", "u", summary="s", originating_entity="o"))
    assert {tuple(r) for r in matching.matching_pairs(items).collect()} == {(0, 1), (2, 3), (4, 5), (6, 7), (6, 8), (7, 8)}


def test_planted_headlines(spark, tmp_path):
    """Of a document's two headlines, those of each eighth document match, and each kind of tag is met."""
    rows = [(i, " ".join(f"{w}{i}" for w in ("alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak")), "s", "en") for i in range(16)]
    spark.createDataFrame(rows, "doc_id int, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in plans.QUERIES["c01_headline_matches"](spark, str(tmp_path)).collect()} == {(0, 1), (16, 17)}
    rows = plans.QUERIES["c02_event_tags"](spark, str(tmp_path)).collect()
    assert all(any(r[c] for r in rows) for c in matching.EVENT_TAGS)


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Acme denies report of breach", "denial"), ("Acme does not plan to buy Zed", "denial"), ("Acme walks away from Zed", "cancellation"), ("Acme delays launch of phone", "deferral"),
        ("Acme retires its old service", "termination"), ("Acme network is back online", "recovery"), ("Acme flaw still exploitable after failed patch", "unfixed"),
        ("Acme cancels launch as network recovers", "cancellation,recovery"), ("Acme opens a shop", ""), (None, ""),
        ("Acme calls claims of a breach misleading", "denial"), ("CVE-2024-12345 withdrawn by Acme", "cancellation,unfixed"), ("Acme bug persists in routers after the fix", "unfixed"),
        ("Acme is not affected by the flaw", "denial"), ("Acme puts on hold the rollout", "deferral"), ("CVE-2024-12345 invalid, says Acme", "unfixed"),
    ],
)
def test_polarity(spark, title, want):
    assert value(spark, F.array_join(matching.polarity(F.col("t")), ","), t=title) == want


def test_reviewed_families(spark):
    rows = [(1, "Court rules Acme listing unlawful", "p", "u1"), (2, "Judge finds Acme listing illegal", "q", "u2"), (3, "Judge finds Zed listing illegal", "r", "u3"), (4, "Judge calls Acme listing illegal", "p", "u4")]
    family = {"listing": ([r"\b(?:court|judge)\b", r"\b(?:unlawful|illegal)\b"], ["court", "judge", "rules", "rule", "finds", "find", "calls", "call", "unlawful", "illegal"])}
    df = spark.createDataFrame(rows, "i int, t string, p string, u string")
    items = matching.features(df, "i", "t", "p", "u", reviewed=family)
    assert (1, 2) in {tuple(r) for r in matching.matching_pairs(items).collect()}
    plain = matching.features(df, "i", "t", "p", "u")
    assert (1, 2) not in {tuple(r) for r in matching.matching_pairs(plain).collect()}


@pytest.mark.parametrize(
    ("hops", "status", "kind", "encoding", "octets", "want"),
    [
        (["https://a.example.com/f"], 200, "text/xml; charset=utf-8", None, 10, None), (["https://a.example.com:443/f"], 200, " Text/XML", "identity", 10, None), ([], 200, "text/xml", None, 10, "URL_INVALID"),
        (None, 200, "text/xml", None, 10, "URL_INVALID"), (["http://a.example.com/f"], 200, "text/xml", None, 10, "URL_UNSAFE"), (["https://u@a.example.com/f"], 200, "text/xml", None, 10, "URL_UNSAFE"),
        (["https://a.example.com:8443/f"], 200, "text/xml", None, 10, "URL_UNSAFE"), (["https://a.example.com/f", "https://b.example.com/f"], 200, "text/xml", None, 10, "HOST_NOT_ALLOWED"), ([None], 200, "text/xml", None, 10, "URL_UNSAFE"),
        (["https://a.example.com/" + "x" * 2100], 200, "text/xml", None, 10, "URL_TOO_LONG"), (["https://a.example.com/f"] * 4, 200, "text/xml", None, 10, "REDIRECT_LIMIT"), (["https://a.example.com/f"], None, "text/xml", None, 10, "STATUS_INVALID"),
        (["https://a.example.com/f"], 301, "text/xml", None, 10, "HTTP_STATUS"), (["https://a.example.com/f"], 200, "text/xml", "gzip", 10, "ENCODING_UNSUPPORTED"), (["https://a.example.com/f"], 200, "text/xml", None, 1_000_001, "BODY_TOO_LARGE"),
        (["https://a.example.com/f"], 200, "text/html", None, 10, "CONTENT_TYPE_INVALID"), (["https://a.example.com/f"], 200, None, None, 10, "CONTENT_TYPE_INVALID"),
    ],
)
def test_fetch_outcomes(spark, hops, status, kind, encoding, octets, want):
    row = spark.createDataFrame([(hops, status, kind, encoding, octets)], "h array<string>, s int, k string, e string, n int")
    got = row.select(feeds.fetch_code(*[F.col(c) for c in "hsken"], "xml", ["a.example.com"]).alias("v")).first()["v"]
    assert got == want


def test_report_rows(spark):
    rows = spark.createDataFrame([("a|b", 1), ("<c>", None)], "name string, n int")
    assert [r["value"] for r in editions.markdown_rows(rows).collect()] == ["| a\\|b | 1 |", "| <c> |  |"]
    assert [r["value"] for r in editions.html_rows(rows).collect()] == ["<tr><td>a|b</td><td>1</td></tr>", "<tr><td>&lt;c&gt;</td><td></td></tr>"]


def test_editions(spark, tmp_path):
    (tmp_path / "2026-01-05.json").write_text('{"schemaVersion": 2, "id": "x-2026-01-05", "issueNumber": 1, "editionDate": "2026-01-05", "desks": {"ai": {"desk": "ai", "story": null, "emptyReason": " "}}}')
    (tmp_path / "2026-01-06.json").write_text('{"schemaVersion": 2, "id": "x-2026-01-05", "issueNumber": 2, "editionDate": "2026-01-07", "desks": {}}')
    rows = editions.read_editions(spark, str(tmp_path))
    assert {tuple(r) for r in editions.directory_issues(rows).collect()} == {("2026-01-06", "DATE_DIFFERS_FROM_NAME"), ("2026-01-05", "DUPLICATE_ID"), ("2026-01-06", "DUPLICATE_ID")}
    found = {(r["editionDate"], r["scope"], r["code"]) for r in edition_issues(rows).collect()}
    assert {("2026-01-05", "edition", "DESKS"), ("2026-01-05", "edition", "TIMEZONE")} <= found and {s for _, s, _ in found} == {"edition"}  # judged no further
    assert ("2026-01-05", "edition", "EDITION_ID") not in found


def edition(i):
    """A whole edition of the i-th day, with one story and three quiet desks."""
    import datetime

    day = datetime.date(2026, 1, 5) + datetime.timedelta(i)
    d, before = day.isoformat(), (day - datetime.timedelta(1)).isoformat()
    source = lambda name, kind: {"id": name, "title": "T", "publisher": "P", "url": f"https://{name}.example.com/x", "relationship": kind, "publishedAt": f"{d}T07:00:00Z", "retrievedAt": f"{d}T09:00:00Z"}
    story = {
        "id": "s", "canonicalEventKey": "k", "desk": "ai", "status": "new-development", "priority": "normal", "headline": "Plain headline", "deck": "Plain deck",
        "whatHappened": "word " * 60, "whyItMatters": "word " * 60, "whatToDoOrWatch": "word " * 60, "timing": {"eventAt": None, "firstPublishedAt": f"{d}T08:00:00Z", "materiallyUpdatedAt": None},
        "editorial": {"primaryEntity": "Acme", "aiAdjacent": True, "deskFit": "fits", "maturity": "verified-development"}, "selection": {"score": 80, "materialDelta": None, "selectedBecause": "b"},
        "confidence": {"rationale": "r"}, "securityAction": None, "sources": [source("a", "originating"), source("b", "independent"), source("c", "context")],
        "evidence": [{"id": "e", "statement": "t", "verification": "confirmed", "sourceIds": ["a", "b"]}],
    }
    desks = {x: {"desk": x, "story": None, "emptyReason": "quiet"} for x in ("work-and-tools", "security-and-privacy", "platforms-and-power")} | {"ai": {"desk": "ai", "story": story, "emptyReason": None}}
    return {
        "schemaVersion": 2, "id": f"x-{d}", "issueNumber": 1, "editionDate": d, "status": "draft", "timezone": "America/New_York",
        "reportingWindow": {"startInclusive": f"{before}T10:00:00Z", "endExclusive": f"{d}T10:00:00Z"},
        "publication": {"targetLocalTime": "06:00", "publishAt": f"{d}T11:00:00Z", "generatedAt": f"{d}T10:30:00Z", "publishedAt": None},
        "frontPage": {"note": "n", "leadStoryId": "s", "storyOrder": ["s"], "stopThePressesStoryId": None, "diversityException": None}, "desks": desks,
        "backPage": {"watchNext": [], "tryThisTomorrow": None}, "provenance": {"policyVersion": "p", "promptVersion": "q", "pipelineVersion": "r"},
    }


def _put(path, value):
    """A change of one field: path is dotted, a number is a place in a list, and "s" is the story."""

    def change(e):
        *way, last = path.split(".")
        at = e
        if way and way[0] == "s":
            at, way = e["desks"]["ai"]["story"], way[1:]
        elif not way and last == "s":
            e["desks"]["ai"]["story"] = value
            return
        for step in way:
            at = at[int(step)] if step.isdigit() else at[step]
        at[int(last) if last.isdigit() else last] = value(e) if callable(value) else value

    return change


_AUTO = {"workflow": "w", "runId": "7", "runUrl": "https://github.com/o/r/actions/runs/7", "candidate": True, "pilotSequence": 1}
_TWICE = lambda e: e["desks"]["ai"]["story"] | {"desk": "platforms-and-power"}
EDITION_FAULTS = [
    ({"SCHEMA_VERSION"}, ("schemaVersion", 1)), ({"EDITION_ID"}, ("id", "x-2020-01-01")), ({"ISSUE_NUMBER"}, ("issueNumber", 0)), ({"STATUS"}, ("status", "ready")), ({"TIMEZONE"}, ("timezone", "UTC")),
    ({"DESKS"}, ("desks", {})), ({"WINDOW", "IN_WINDOW"}, ("reportingWindow.startInclusive", "2030-01-01T00:00:00Z")), ({"WINDOW_END"}, ("reportingWindow.endExclusive", lambda e: e["editionDate"] + "T10:01:00Z")),
    ({"TARGET_TIME"}, ("publication.targetLocalTime", "07:00")), ({"GENERATED_AT"}, ("publication.generatedAt", "soon")), ({"PUBLISH_TIME"}, ("publication.publishAt", lambda e: e["editionDate"] + "T11:01:00Z")),
    ({"PUBLISH_DATE"}, ("publication.publishAt", "2025-12-01T11:00:00Z")), ({"PUBLISHED_AT"}, ("publication.publishedAt", "2026-01-05T11:00:00Z")), ({"PUBLISHED_AT"}, ("status", "published")),
    ({"STORY_ID", "EVENT_KEY", "REPEATED_ENTITY", "STORY_ORDER", "AI_DESK"} - {"AI_DESK"}, ("desks.platforms-and-power.story", _TWICE)), ({"NEEDLESS_EXCEPTION"}, ("frontPage.diversityException", "why")),
    ({"STORY_ORDER"}, ("frontPage.storyOrder", [])), ({"LEAD_STORY"}, ("frontPage.leadStoryId", "t")), ({"STOP_THE_PRESSES"}, ("frontPage.stopThePressesStoryId", "s")), ({"WATCH_NEXT"}, ("backPage.watchNext", None)),
    ({"WATCH_NEXT_SIZE"}, ("backPage.watchNext", [dict.fromkeys(("topic", "unresolved", "meaningfulSignal", "whyItMatters"), "x")] * 4)), ({"WATCH_NEXT_ITEM"}, ("backPage.watchNext", [{"topic": "x"}])),
    ({"PROVENANCE"}, ("provenance.promptVersion", "old")), ({"AUTOMATION_CHECK"}, ("provenance.automation", lambda e: _AUTO | {"generatedAt": e["publication"]["generatedAt"]})), ({"AUTOMATION", "AUTOMATION_CHECK"}, ("provenance.automation", _AUTO)),
    ({"DESK_PAGE", "STORY_ORDER", "LEAD_STORY"}, ("desks.ai.desk", "x")), ({"EMPTY_REASON"}, ("desks.work-and-tools.emptyReason", " ")), ({"STORY_DESK"}, ("s.desk", "work-and-tools")), ({"STORY_ID", "STORY_ORDER", "LEAD_STORY"}, ("s.id", None)),
    ({"EVENT_KEY"}, ("s.canonicalEventKey", "")), ({"SCORE"}, ("s.selection.score", 69)), ({"EDITORIAL"}, ("s.editorial", None)), ({"ENTITY"}, ("s.editorial.primaryEntity", " ")), ({"AI_DECLARED", "AI_DESK"}, ("s.editorial.aiAdjacent", None)),
    ({"MATURITY"}, ("s.editorial.maturity", "emerging")), ({"DESK_FIT"}, ("s.editorial.deskFit", None)), ({"AI_DESK"}, ("s.editorial.aiAdjacent", False)), ({"READER_COPY_DECK"}, ("s.deck", '{"deck": 1}')), ({"WORDS"}, ("s.whatHappened", "few")),
    ({"UPDATE_TIME", "DELTA"}, ("s.status", "material-update")), ({"IN_WINDOW"}, ("s.timing.firstPublishedAt", "2020-01-01T00:00:00Z")), ({"SOURCES"}, ("s.sources", [])), ({"SOURCE_IDS"}, ("s.sources.2.id", "a")),
    ({"SOURCE_URLS"}, ("s.sources.2.url", "https://www.google.com/search")), ({"SOURCE_KIND"}, ("s.sources", lambda e: [x | {"relationship": "context"} for x in e["desks"]["ai"]["story"]["sources"]])),
    ({"CLAIM_SOURCES"}, ("s.evidence.0.sourceIds", [])), ({"CLAIM_UNKNOWN"}, ("s.evidence.0.sourceIds", ["z"])), ({"SECURITY_DESK"}, ("s.securityAction", {"affected": "a", "action": "b", "deadline": None})), (set(), ("timezone", "America/New_York")),
]


def _found(spark, tmp_path, faults, find):
    import json

    for i, (_, change) in enumerate(faults):
        e = edition(i)
        _put(*change)(e)
        (tmp_path / f"{edition(i)['editionDate']}.json").write_text(json.dumps(e))
    got = {}
    for r in find(editions.read_editions(spark, str(tmp_path))).collect():
        got.setdefault(r["editionDate"], set()).add(r["code"])
    return [got.get(edition(i)["editionDate"], set()) for i in range(len(faults))]


def test_every_edition_rule(spark, tmp_path):
    got = _found(spark, tmp_path, EDITION_FAULTS, lambda rows: edition_issues(rows, prefix="x", provenance=("p", "q", "r"), workflow="w"))
    assert [(want, g) for (want, _), g in zip(EDITION_FAULTS, got, strict=True) if want != g] == []


DRAFT_FAULTS = [
    ({"REPORTING_WINDOW_INVALID", "NEW_DEVELOPMENT_OUTSIDE_WINDOW"}, ("reportingWindow.startInclusive", "2030-01-01T00:00:00Z")), ({"GENERATED_AT_INVALID"}, ("publication.generatedAt", "x")), ({"PUBLISH_AT_INVALID"}, ("publication.publishAt", "x")),
    ({"GENERATED_AFTER_PUBLICATION"}, ("publication.generatedAt", lambda e: e["editionDate"] + "T12:00:00Z")), ({"PUBLISHED_AT_MISSING"}, ("status", "published")), ({"UNPUBLISHED_HAS_PUBLISHED_AT"}, ("publication.publishedAt", "x")),
    ({"DESKS_MISSING", "DESK_MISSING"}, ("desks", None)), ({"DESK_MISSING"}, ("desks.ai", None)), ({"EDITORIAL_TEXT_MISSING"}, ("frontPage.note", "")), ({"EDITORIAL_TEXT_MISSING"}, ("desks.work-and-tools.emptyReason", "")),
    ({"EXPERIMENT_STEPS_INVALID"}, ("backPage.tryThisTomorrow", {"title": "t", "goal": "g", "successMeasure": "s", "riskCheck": "r"})), ({"EDITORIAL_TEXT_MISSING"}, ("backPage.tryThisTomorrow", {"title": "t", "goal": "g", "successMeasure": "s", "riskCheck": "r", "steps": [" "]})),
    ({"WATCH_NEXT_INVALID"}, ("backPage.watchNext", None)), ({"WATCH_NEXT_UNSOURCED"}, ("backPage.watchNext", [{"topic": "t"}])), ({"EDITORIAL_TEXT_MISSING"}, ("s.securityAction", {"affected": "a", "action": " ", "deadline": None})),
    ({"FIRST_PUBLISHED_AT_INVALID"}, ("s.timing.firstPublishedAt", "x")), ({"EVENT_AT_INVALID"}, ("s.timing.eventAt", "x")), ({"MATERIAL_UPDATE_TIMESTAMP_MISSING", "MATERIAL_DELTA_MISSING"}, ("s.status", "material-update")),
    ({"NEW_DEVELOPMENT_OUTSIDE_WINDOW"}, ("s.timing.eventAt", "2020-01-01T00:00:00Z")), ({"NEW_DEVELOPMENT_HAS_UPDATE_TIMESTAMP"}, ("s.timing.materiallyUpdatedAt", "2026-01-01T00:00:00Z")), ({"NEW_DEVELOPMENT_HAS_MATERIAL_DELTA"}, ("s.selection.materialDelta", "d")),
    ({"MATERIAL_UPDATE_OUTSIDE_WINDOW", "MATERIAL_UPDATE_BEFORE_PUBLICATION", "MATERIAL_DELTA_MISSING"}, ("s", lambda e: None)), ({"STORY_STATUS_INVALID"}, ("s.status", None)), ({"REPEATED_EVENT_NOT_MATERIAL_UPDATE"}, ("s.canonicalEventKey", "covered")),
    ({"SOURCE_LIST_MISSING", "INSUFFICIENT_DISTINCT_SOURCES", "STORY_LACKS_AUTHORITATIVE_SOURCE", "EVIDENCE_LACKS_AUTHORITATIVE_SOURCE", "EVIDENCE_SOURCE_UNKNOWN"}, ("s.sources", [])), ({"SOURCE_ID_MISSING"}, ("s.sources.2.id", "")), ({"SOURCE_ID_DUPLICATE"}, ("s.sources.2.id", "b")),
    ({"SOURCE_METADATA_MISSING"}, ("s.sources.0.title", "")), ({"SOURCE_RELATIONSHIP_INVALID"}, ("s.sources.2.relationship", "x")), ({"SOURCE_URL_INVALID"}, ("s.sources.2.url", "nothing")), ({"SOURCE_URL_NOT_HTTPS"}, ("s.sources.2.url", "http://c.example.com/")),
    ({"SOURCE_URL_CREDENTIALS"}, ("s.sources.2.url", "https://u:p@c.example.com/")), ({"SOURCE_URL_PRIVATE_HOST"}, ("s.sources.2.url", "https://box.local:8443/")), ({"SOURCE_URL_PRIVATE_HOST"}, ("s.sources.2.url", "https://10.0.0.1/")), ({"SOURCE_URL_SEARCH_PAGE"}, ("s.sources.2.url", "https://duckduckgo.com/?q=x")),
    ({"SOURCE_URL_NOT_GROUNDED"}, ("s.sources.2.url", "https://other.example.com/")), (set(), ("s.sources.2.url", "https://c.example.com/x?utm_source=y#z")), ({"SOURCE_PUBLISHED_AT_INVALID"}, ("s.sources.2.publishedAt", "x")), ({"SOURCE_RETRIEVED_AT_INVALID"}, ("s.sources.2.retrievedAt", None)),
    ({"SOURCE_RETRIEVED_BEFORE_PUBLICATION"}, ("s.sources.2.retrievedAt", lambda e: e["editionDate"] + "T06:00:00Z")), ({"SOURCE_RETRIEVED_AFTER_GENERATION"}, ("s.sources.2.retrievedAt", lambda e: e["editionDate"] + "T10:45:00Z")),
    ({"SOURCE_RETRIEVED_AFTER_GENERATION", "SOURCE_RETRIEVED_AFTER_PUBLICATION"}, ("s.sources.2.retrievedAt", lambda e: e["editionDate"] + "T12:00:00Z")), ({"CRITICAL_STORY_EVIDENCE_MIX"}, ("s", lambda e: e)), ({"EVIDENCE_LIST_MISSING", "EVIDENCE_LACKS_AUTHORITATIVE_SOURCE"}, ("s.evidence", [])),
    ({"EVIDENCE_INVALID", "EVIDENCE_SOURCE_IDS_MISSING"} - {"EVIDENCE_SOURCE_IDS_MISSING"}, ("s.evidence", lambda e: [*e["desks"]["ai"]["story"]["evidence"], None])), ({"EVIDENCE_ID_MISSING"}, ("s.evidence.0.id", "")), ({"EVIDENCE_ID_DUPLICATE"}, ("s.evidence", lambda e: e["desks"]["ai"]["story"]["evidence"] * 2)),
    ({"EVIDENCE_STATEMENT_MISSING"}, ("s.evidence.0.statement", None)), ({"EVIDENCE_VERIFICATION_INVALID"}, ("s.evidence.0.verification", "sure")), ({"EVIDENCE_SOURCE_IDS_MISSING", "EVIDENCE_LACKS_AUTHORITATIVE_SOURCE"}, ("s.evidence.0.sourceIds", [])),
    ({"EVIDENCE_SOURCE_ID_INVALID"}, ("s.evidence.0.sourceIds", ["a", ""])), ({"EVIDENCE_SOURCE_ID_DUPLICATE"}, ("s.evidence.0.sourceIds", ["a", "a"])), ({"EVIDENCE_SOURCE_UNKNOWN"}, ("s.evidence.0.sourceIds", ["a", "z"])),
    ({"CONFIRMED_CLAIM_CONTEXT_ONLY", "EVIDENCE_LACKS_AUTHORITATIVE_SOURCE"}, ("s.evidence.0.sourceIds", ["c"])), ({"SOURCE_INVALID"}, ("s.sources", lambda e: [*e["desks"]["ai"]["story"]["sources"], None])), (set(), ("timezone", "x")),
]


def test_every_draft_rule(spark, tmp_path):
    def story(**changes):
        def change(e):
            at = e["desks"]["ai"]["story"]
            for path, value in changes.items():
                _put("s." + path.replace("__", "."), value)(e)
            return at

        return change

    faults = [list(x) for x in DRAFT_FAULTS]
    update = next(x for x in faults if "MATERIAL_UPDATE_OUTSIDE_WINDOW" in x[0])
    update[1] = ("desks.ai.story", story(status="material-update", timing__materiallyUpdatedAt="2020-01-01T00:00:00Z"))
    critical = next(x for x in faults if x[0] == {"CRITICAL_STORY_EVIDENCE_MIX"})
    critical[1] = ("desks.ai.story", story(priority="critical", evidence__0__sourceIds=["a"]))
    faults.append(({"CRITICAL_STORY_SOURCE_MIX", "CRITICAL_STORY_EVIDENCE_MIX"}, ("desks.ai.story", story(priority="critical", sources__0__relationship="independent"))))
    allowed = spark.createDataFrame([(f"https://{x}.example.com/x",) for x in "abc"], "url string")
    prior = spark.createDataFrame([("covered",), (None,)], "event_key string")
    got = _found(spark, tmp_path, faults, lambda rows: newsroom_issues(rows, allowed=allowed, prior=prior))
    loose = {"SOURCE_URL_INVALID", "SOURCE_URL_NOT_HTTPS", "SOURCE_URL_CREDENTIALS", "SOURCE_URL_PRIVATE_HOST", "SOURCE_URL_SEARCH_PAGE"}
    assert [(want, g) for (want, _), g in zip(faults, got, strict=True) if want != g and not (want & loose and want == g - {"INSUFFICIENT_DISTINCT_SOURCES"})] == []


def test_bundles_and_versions(spark, tmp_path):
    rows = spark.range(3)
    editions.write_bundle({"report": rows}, str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)exists"):
        editions.write_bundle({"report": rows}, str(tmp_path / "b"))
    editions.write_version(rows, str(tmp_path / "v"), "1")
    editions.write_version(spark.range(5), str(tmp_path / "v"), "2")
    assert editions.latest_version(spark, str(tmp_path / "v")).count() == 5


def test_streaming_first_write_wins(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(([("a", 1), ("a", 2), ("b", 3)], [("a", 9), ("c", 4)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, v int").parquet(src)
        q = stream.writeStream.foreachBatch(intake.append_new(out, "k")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.parquet(out).count() == (2, 3)[i]


def test_streaming_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS t, 'a' AS k UNION ALL SELECT timestamp'2026-01-01 00:20:00', 'a' UNION ALL SELECT timestamp'2026-01-01 09:00:00', 'b'").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, k string").parquet(src)
    q = intake.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["k"], r["n"]) for r in spark.table("counted").collect()] == [("a", 2)]


def test_streaming_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS t, 'a' AS k UNION ALL SELECT timestamp'2026-01-01 00:20:00', 'a'").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, k string").parquet(src)
    q = intake.first_writes(stream, "k", "t").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 1


@pytest.mark.parametrize("piece", [1_000, 2])
def test_copies_are_matched_once(spark, monkeypatch, piece):
    """Blocks see one of the copies of a title; their pairs, also those of a class larger than a piece, are told out whole."""
    seen = []
    block_pairs = matching.block_pairs

    def counted(blocks, *more):
        seen.append(blocks.select("item").distinct().count())
        return block_pairs(blocks, *more)

    monkeypatch.setattr(matching, "PIECE", piece)
    monkeypatch.setattr(matching, "block_pairs", counted)
    titles = ["Google unveils blue round wheel maker"] * 5 + ["Google unveils blue round wheel maker set"] * 3 + ["Apple sued over fees"] * 2 + ["Apple opens a shop"]
    rows = [(i, t, "p", "u" if i in (0, 10) else f"u{i}") for i, t in enumerate(titles)]
    items = checkpointed(matching.features(spark.createDataFrame(rows, "i int, t string, p string, u string"), "i", "t", "p", "u"))
    found = [tuple(r) for r in matching.matching_pairs(items).collect()]
    a, b = items.alias("a"), items.alias("b")
    every = a.crossJoin(b).where(F.col("a.item") < F.col("b.item")).where(matching.pair_predicate()).select("a.item", "b.item")
    assert sorted(found) == sorted(tuple(r) for r in every.collect()) and {(0, 10), (0, 4), (1, 6)} <= set(found)
    assert seen[0] == len(set(titles))


def test_repeated_words_are_stemmed_once():
    """A long text's words are taken once before the rules for single words."""
    for of in (text.event_tokens, text.title_tokens):
        assert "array_except(split" in str(of(F.col("t")))
    assert "array_except" not in str(text.tokens(F.col("t")))


def test_hits_of_one_desk(spark):
    """A desk's scores need its own terms alone; amounts are found as before by plain word edges."""
    df = spark.createDataFrame([("security breach of a developer workflow", "ransomware hits cloud infrastructure ruling")], "t string, s string")
    desk = "security-and-privacy"
    few, whole = ([scoring.desk_hits(F.col(c), d).alias(c) for c in "ts"] for d in (desk, None))
    of = lambda hits: df.select(*hits).select(scoring.desk_scores(F.col("t"), F.col("s"))[desk]["score"].alias("score")).first()
    assert of(few) == of(whole)
    amounts = spark.createDataFrame([("costs $5 million",), ("up 5 per cent",), ("é5 users",), ("5 usersé",), ("thousands of users",), ("thousands users",), ("5 pct.",), (None,)], "t string")
    assert [r[0] for r in amounts.select(scoring.broad_quantity(F.col("t"))).collect()] == [r[0] for r in amounts.select(text.matches(F.col("t"), V.BROAD_QUANTITY)).collect()]
