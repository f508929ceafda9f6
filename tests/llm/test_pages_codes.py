import gzip
import json
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.llm import consensus, hamming, warc

REC = "tile_id long, swin_features array<float>, note string"


def brute_code(v):
    if not v:
        return None
    sums = [0.0] * 64
    for i, x in enumerate(v):
        sums[i % 64] += 0.0 if x is None or x != x else float(x)
    return sum(1 << b for b, s in enumerate(sums) if s > 0)


def brute_nearest(records, queries, k):
    out = Counter()
    codes = [(t, brute_code(v)) for t, v in records if brute_code(v) is not None]
    for t, v in queries:
        q = brute_code(v)
        if q is not None:
            best = sorted(((q ^ c).bit_count(), n is None, n or 0) for n, c in codes)[:k]
            out.update((t, i + 1, None if null else n, d) for i, (d, null, n) in enumerate(best))
    return out


@pytest.mark.parametrize("segments", [None, 3])
def test_nearest_tiles_equal_brute_force(spark, segments):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * (i % 5) * 0.3).tolist()) for i in range(300)]
    rows += [(300 + i, base[0].tolist()) for i in range(100)]  # a quarter of all rows are copies
    rows += [(500, None), (501, []), (None, base[1].tolist()), (502, [0.0] * 64), (503, [None, float("nan"), *[1.0] * 700]), (7, rows[7][1])]
    records = spark.createDataFrame([(*r, "n") for r in rows], REC)
    asked = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] >= 500]
    got = hamming.nearest_tiles(records, spark.createDataFrame([(*r, "n") for r in asked], REC), 5, segments).collect()
    assert Counter(map(tuple, got)) == brute_nearest(rows, asked, 5)


def test_nearest_tiles_with_few_or_no_rows(spark):
    records = spark.createDataFrame([(1, [1.0] * 64, ""), (2, [-1.0] * 64, "")], REC)
    got = hamming.nearest_tiles(records, records, 10).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 0), (1, 2, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64)]
    assert hamming.nearest_tiles(records.filter("false"), records, 3).count() == 0
    assert hamming.nearest_tiles(records, records.filter("false"), 3).count() == 0


ARTICLE = "<h1>A &amp; title</h1><p>First <b>bold</b>  text&nbsp;here<br>goes on.</p><p>Second &#8211; one, &eacute;"
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';if(1<2){}</script></head><body class='page-1'>"
NAV = "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>News of the day and more</a></ul></nav><header><p>Our fine paper</p></header>"
FOOT = "<aside><p>Aside words which are rather long but not of the article at all.</p></aside><footer>&copy; us</footer>"
WANT = "A & title\n\nFirst bold text here goes on.\n\nSecond – one, é"


@pytest.mark.parametrize("name,html,want", [
    ("article", f"{HEAD}{NAV}<!-- ad --><div class='ad'>Buy now</div><article>{ARTICLE}</article>{FOOT}</body></html>", WANT),
    ("cut off", f"{HEAD}{NAV}<article>{ARTICLE}", WANT),
    ("div", f"{HEAD}{NAV}<div id='wrap'><div class='post-body'>{ARTICLE}</p></div><div class='sidebar'><p>{'Other things to read. ' * 9}</p></div></div>{FOOT}", WANT),
    ("comments", f"{HEAD}<main>{ARTICLE}</p><section id='comments'><p>{'I disagree with it. ' * 30}</p></section></main>{FOOT}", WANT),
    ("notice", f"{HEAD}<div class='cookie-notice'><p>{'We use cookies. ' * 20}</p></div><article>{ARTICLE}</p><form><p>Sign up</p><input></form></article>", WANT),
    ("nested comment", f"{HEAD}<article>{ARTICLE}</p><article class='comment'><p>Mine too.</p></article></article>", WANT),
    ("sections", f"{HEAD}<article><h1>A &amp; title</h1><section><p>First <i>bold</i> text here goes on.</p></section><section><p>Second – one, é</section></article>", WANT),
    ("list and table", f"{HEAD}<article><p>Before it all came this.</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>",
     "Before it all came this.\n\none\n\ntwo\n\nc1\n\nc2"),
    ("attributes", f"{HEAD}<article data-x='a>b' title=\"1 > 0\"><p title='x'>Quoted  attributes,\n stay.</article>", "Quoted attributes, stay."),
    ("empty", "", ""), ("null", None, ""), ("no text", f"{HEAD}{NAV}", ""), ("plain", "just words < 3 & more", "just words < 3 & more"),
])
def test_main_text_of_a_page(name, html, want):
    assert consensus.main_text(consensus.parse(html or ""), None) == want


def test_hosts_agree_on_a_path(spark):
    def page(i, box, other):
        return f"{HEAD}<div class='c{i} story'><p>{box}</p></div><div class='teaser'><p>{other}</p></div>"
    rows = [(i, f"https://a.example.com/{i}", page(i, "The long main text of this page. " * 9, "Short teaser.")) for i in range(8)]
    # On this page alone the teaser is longer; the host's path decides.
    rows += [(50, "https://A.example.com:80/x?y", page(9, "Main but short.", "A teaser that goes on and on, it seems. " * 9)),
             (51, None, page(1, "Alone.", "x")), (52, "nonsense", None), (53, "https://b.example.com", ""), (53, "https://b.example.com", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = consensus.extract_pages(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == len(rows)
    text = {r.page_id: r.text for r in got.collect()}
    assert text[50] == "Main but short." and text[3] == ("The long main text of this page. " * 9).strip() and text[52] == text[53] == ""
    assert consensus.extract_pages(df.filter("false")).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<a <b ", "&amp;", "<!--", "<p title='", "<script>", "</p>", "x" * 50])
def test_broken_and_deep_pages_take_linear_time(piece):
    consensus.main_text(consensus.parse(piece * 3000), None)


@pytest.mark.parametrize("page", [
    "<div class='a'>x" * 100_000, "<ul>x" * 100_000, "<div>" * 100_000 + "</p>x" * 100_000, "<i>" * 100_000 + "<li>x" * 100_000,
    "<b>" * 100_000 + "</i>x" * 100_000, "<a " + "b" * 500_000 + ">x"])
def test_a_hundred_thousand_nested_elements_are_read_in_one_pass(page):
    started = time.process_time()
    text = consensus.main_text(consensus.parse(page), None)
    assert len(text.replace("\n", "").replace("x", "")) == 0 and time.process_time() - started < 8


def test_archives_round_trip(spark, tmp_path):
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(5, "http://a/5", big), (3, "http://a/3 x\r\nX: y", big), (9, None, big), (None, "http://a/n", big), (3, "http://a/3b", big), (1, "u", small), (2, "u", small),
            (7, "u", None), (8, None, "z" * 3_000_000), (11, "é", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, offset string").coalesce(3)
    folder = str(tmp_path / "w")
    got = Counter(map(tuple, warc.archive_pages(spark, df, folder).collect()))
    import hashlib
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and data == big.encode() and page != 3
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want and warc.archive_pages(spark, df.filter("false")).count() == 0
    # Every member stands alone at the offset its sidecar gives, and together they are the file.
    names = [n for n in os.listdir(f"{folder}/members") if n.endswith(".gz")]
    assert names and not os.listdir(f"{folder}/whole") and not [n for n in os.listdir(f"{folder}/members") if "attempt" in n]
    for n in names:
        data = open(f"{folder}/members/{n}", "rb").read()
        at = 0
        for line in map(json.loads, open(f"{folder}/members/{n}.idx")):
            assert line["offset"] == at and zlib.decompress(data[at:at + line["length"]], 31).startswith(b"WARC/1.1\r\nWARC-Type: " + line["record_type"].encode())
            at += line["length"]
        assert at == len(data) and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == sum(1 for _ in open(f"{folder}/members/{n}.idx"))


def test_normaliser_takes_members_and_refuses_cut_files(spark, tmp_path):
    one = warc.record(1, "http://x/é", b"a" * 10, "00", None, "2024-01-01T00:00:00Z")
    two = warc.record(2, None, b"", "11", 1, "2024-01-01T00:00:00Z")
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/whole.warc.gz").write_bytes(gzip.compress(one + two))
    (tmp_path / "in/members.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    df = spark.createDataFrame([(f"file://{tmp_path}/in/{n}.warc.gz", 1) for n in ("whole", "members")], "archive string, length int")
    index = warc.normalise_archives(df, f"file://{tmp_path}/out").collect()
    assert sorted((r.archive.rsplit("/")[-1], r.page_id, r.record_type) for r in index) == [
        (f"{n}.warc.gz", p, k) for n in ("members", "whole") for p, k in (("1", "response"), ("2", "revisit"))]
    assert (tmp_path / "in/whole.warc.gz").exists()
    (tmp_path / "in/cut.warc.gz").write_bytes(gzip.compress(one + two)[:-12])
    with pytest.raises(Exception, match="ends"):
        warc.normalise_archives(spark.createDataFrame([(f"file://{tmp_path}/in/cut.warc.gz",)], "archive string"), f"file://{tmp_path}/out2")
