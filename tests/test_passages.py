"""T19 and S09 case by case, with results written by hand."""

from deskloom.functions.prose import select_passages
from deskloom.sources import pages

FILLER = [f"Background section {i} describes a historical part of the company's documentation and general operating processes without making a specific new product announcement." for i in range(45)]
IMPACT = "The flaw permits execution of arbitrary code before the operating system starts."
CONDITION = "This impact requires Secure Boot to be disabled and is not a claim that every configuration has the same exposure."


def test_caveats_keep_their_neighbours():
    kept = select_passages([*FILLER, IMPACT, CONDITION, "The advisory does not establish exploitation in the wild."], "")
    assert kept[-3:] == [IMPACT, CONDITION, "The advisory does not establish exploitation in the wild."]
    assert len("\n".join(kept)) <= 5_800 and len(kept) <= 40


def test_a_block_that_stands_alone_takes_no_neighbour():
    background = "Background content without useful detail. " * 160
    alone = "The publisher announced new access controls for its developer service. Administrators can now restrict access to shared caches. Availability depends on the selected plan."
    assert select_passages([background, alone], background, 5_000) == [alone]


def test_a_condition_is_not_kept_without_what_it_is_about():
    assert select_passages(["The backup driver permits writes to physical disks. " * 110, "This impact requires Secure Boot to be disabled first."], "", 5_000) == []


def test_a_detail_before_a_condition_comes_with_it():
    blocks = ["x" * 300, "The driver changes disk access.", "Local users must log in first.", "y" * 300]
    assert select_passages(blocks, "", 70) == blocks[1:3]
    assert select_passages([blocks[0], "Plain words in a row here.", blocks[2], blocks[3]], "", 50) == [blocks[2]]


def test_a_condition_with_a_detail_is_a_caveat():
    blocks = [*FILLER[:4], "Several customers see it when logged in.", *FILLER[4:8]]
    assert select_passages(blocks, "", 100) == [blocks[4]]


def test_titles_by_folded_words():
    blocks = [*FILLER[:40], "ＡＯＭＥＩ wrote some more of its text about the disk."]
    assert select_passages(blocks, "aomei disk of the", 60) == [blocks[40]]


def test_equal_blocks_count_once_and_bounds():
    assert select_passages([FILLER[1], f"  {FILLER[1]}  ", FILLER[1].upper()], "") == [FILLER[1]]
    assert select_passages(["x" * 600_001], "") == [] and select_passages([FILLER[1]] * 6_001, "") == []
    assert select_passages([FILLER[1]] * 6_001, "", most=None) == [FILLER[1]]
    assert select_passages([], "t") == [] and select_passages(["short"], "") == []


INTRO = "Example Server contains two distinct local vulnerabilities. The installed version and the relevant advisory determine the applicable remediation."
TABLE = "<table><caption>Releases</caption><tr><th>CVE</th><th>Version</th></tr><tr><td>CVE-2026-1111</td><td>1.0</td></tr><tr><td>CVE-2026-2222</td><td><b>2.0</b></td></tr></table>"


def article(more):
    return f"<html><nav>menu</nav><article><h1>Example advisory</h1><p>{INTRO}</p>{more}</article></html>"


USABLE = {
    TABLE + "<h2>Remediation</h2><p>No patch available.</p>": ["Example advisory — Releases — CVE: CVE-2026-1111; Version: 1.0", "Example advisory — Releases — CVE: CVE-2026-2222; Version: 2.0", "Example advisory — Remediation", "Example advisory — Remediation — No patch available."],
    "<h2>Limits</h2><dl><dt>Prerequisite</dt><dd>Secure Boot is disabled.</dd></dl>": ["Example advisory — Limits", "Example advisory — Limits — Prerequisite: Secure Boot is disabled."],
    "<table><tr><th>Patch</th><td>Not available</td></tr><tr><th>Access</th><td>Local</td></tr></table>": ["Example advisory — Patch: Not available", "Example advisory — Access: Local"],
    "<h5>Deep</h5><h6>Deeper</h6><blockquote><p>Quoted.</p></blockquote><ul><li>One<li>Two</ul>": ["Example advisory — Deep", "Example advisory — Deep — Deeper", "Example advisory — Deep — Deeper — Quoted.", "Example advisory — Deep — Deeper — One", "Example advisory — Deep — Deeper — Two"],
    "<div><p>Within &amp; <i>below</i> a box.</p></div>": ["Example advisory — Within & below a box."],
    f"<p>{'Background explanation. ' * 150}</p><h2>Limits</h2><p>It applies only when external access is off.</p>": ["Example advisory — " + ("Background explanation. " * 150).strip(), "Example advisory — Limits", "Example advisory — Limits — It applies only when external access is off."],
}
HELD = {
    TABLE.replace("<td>1.0</td>", "<td></td>"): "AMBIGUOUS_TABLE", TABLE.replace("<th>Version</th>", "<th>cve</th>"): "AMBIGUOUS_TABLE", TABLE.replace("<th>Version</th>", "<th></th>"): "AMBIGUOUS_TABLE",
    TABLE.replace("<td>1.0</td>", '<td colspan="2">1.0</td>'): "AMBIGUOUS_TABLE", TABLE.replace("<td>1.0</td>", '<td rowspan="1">1.0</td>'): "AMBIGUOUS_TABLE",
    TABLE.replace("<td>1.0</td>", "<td><table><tr><td>1.0</td></tr></table></td>"): "AMBIGUOUS_TABLE", TABLE.replace("</table>", "Footnote: not all are affected.</table>"): "AMBIGUOUS_TABLE",
    TABLE.replace("</td><td>1.0", "</td>Only if off.<td>1.0"): "AMBIGUOUS_TABLE", TABLE.replace("<tr><td>CVE-2026-1111", "<tr><th>A</th><th>B</th></tr><tr><td>CVE-2026-1111"): "AMBIGUOUS_TABLE",
    TABLE.replace("<td>1.0</td>", "<td>1.0"): "AMBIGUOUS_TABLE", TABLE.replace("<caption>", "<caption>Other</caption><caption>"): "AMBIGUOUS_TABLE", "<table></table>": "AMBIGUOUS_TABLE",
    "<table><tr>" + "<td>x</td>" * 13 + "</tr></table>": "AMBIGUOUS_TABLE", "<table>" + "<tr><th>a</th><td>b</td></tr>" * 81 + "</table>": "AMBIGUOUS_TABLE",
    TABLE.replace("</table>", ""): "UNSUPPORTED_ARTICLE_TEXT_STRUCTURE",
    "<dl><dd>Orphan.</dd></dl>": "AMBIGUOUS_DEFINITION_LIST", "<dl><dt>Patch</dt><dd>None.</dd><dd>Another.</dd></dl>": "AMBIGUOUS_DEFINITION_LIST", "<dl><dt>k<dd>v</dl>": "AMBIGUOUS_DEFINITION_LIST", "<dl>x<dt>a</dt><dd>b</dd></dl>": "AMBIGUOUS_DEFINITION_LIST",
    "<div>A prerequisite in no block.</div>": "UNSUPPORTED_ARTICLE_TEXT_STRUCTURE", "<blockquote>Quoted.</blockquote>": "UNSUPPORTED_ARTICLE_TEXT_STRUCTURE",
    "<article><p>Nested report.</p>": "NESTED_ARTICLE_REGION", "<p>To obtain and install the latest</p>": "EVIDENCE_EXTRACTION_INCOMPLETE", "<p>Countries/Areas Deployed: all</p>": "ADVISORY_STRUCTURE_REVIEW",
    f"<p>{'Only local installations are affected. ' * 200}</p>": "REQUIRED_CONTEXT_EXCEEDS_BUDGET",
}


def test_structured_pages(spark):
    other = {"<article><p>Loading article...</p></article>": "ARTICLE_CONTENT_INSUFFICIENT", "<p>none</p>": "ARTICLE_REGION_UNAVAILABLE", "": "ARTICLE_REGION_UNAVAILABLE", "<article> </article>": "ARTICLE_CONTENT_UNAVAILABLE",
             '<main><p>x</p></main><article class="a c-teaser b"><p>Related.</p></article>': "RELATED_ARTICLE_NOT_PRIMARY"}
    cases = [(article(m), "", blocks) for m, blocks in USABLE.items()] + [(article(m), hold, []) for m, hold in HELD.items()] + [(h, hold, []) for h, hold in other.items()] + [(None, "ARTICLE_REGION_UNAVAILABLE", [])]
    df = spark.createDataFrame([(i, html, "clash") for i, (html, _, _) in enumerate(cases)], "page_id int, html string, blocks string")
    got = {r["page_id"]: r for r in pages.structured_pages(df, "page_id", "html").collect()}
    start = ["Example advisory", f"Example advisory — {INTRO}"]
    for i, (html, hold, blocks) in enumerate(cases):
        r = got[i]
        assert (r["status"], r["holds"]) == (("held", [hold]) if hold else ("usable", [])), (html, r)
        assert r["blocks"] == ([] if hold else [*start, *blocks]), (html, r)
        assert hold or r["input_blocks"] == len(start) + 1 + len(blocks)
    assert pages.structured_pages(df.limit(0), "page_id", "html").count() == 0
    assert {r["holds"][0] for r in got.values() if r["holds"]} == set(pages.HOLDS)


