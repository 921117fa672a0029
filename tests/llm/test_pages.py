"""HTML extraction, archives and URL verdicts."""

import hashlib
import html
import re
import time

import pytest

from tidemark.llm import arc as A
from tidemark.llm import html_text as H
from tidemark.llm import mapped as M
from tidemark.llm import url_filter as U

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body class="page">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy this thing now, it is very good.</div>
%s
<div class="cookie-notice">We use cookies.</div><form><label>Mail</label><input></form><footer>&copy; Site</footer></body></html>"""
ARTICLE = "<article><header><h1>The &amp; title</h1></header><p>One   two\n three&nbsp;four.<br>five<p>As.<aside>An aside.</aside><ul><li>six<li>seven <b>bold</ul><section class='comments'><p>First!</p></section></article>"


def test_named_article():
    assert H.main_text(PAGE % ARTICLE) == "The & title\nOne two three four.\nfive\nAs.\nsix\nseven bold"


def test_line_blocks_without_a_named_article():
    body = "<div><p>" + "A long paragraph with many words in it. " * 3 + "</p><p>Short.</p><p>" + "Another one with words of its own. " * 3 + "</p></div><div><a href=1>x</a><br><a href=2>y</a><br><a href=3>z</a><br><a>w</a></div><p>tiny</p>"
    lines = H.main_text(PAGE % body).split("\n")
    assert [x[:7] for x in lines] == ["A long ", "Short.", "Another"]


def test_every_part_of_a_named_article_stays():
    apart = "<p>beside</p>" * 4
    assert H.main_text(PAGE % f"<article><p>One.</p></article>{apart}<article><p>Two, which is longer.</p></article>") == "One.\nTwo, which is longer."


def test_links_inside_the_text_do_not_cut_it():
    long, other = "A long paragraph with many words in it. " * 3, "Another one with words of its own. " * 2
    links = "<ul>" + "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(4)) + "</ul>"
    want = [long.strip(), *(f"link {i}" for i in range(4)), other.strip()]
    assert H.main_text(PAGE % f"<div><p>{long}</p>{links}<p>{other}</p></div>").split("\n") == want
    assert H.main_text(PAGE % f"<div><div><p>{long}</p></div>{links}<p>{other}</p></div>").split("\n") == want
    assert H.main_text(PAGE % f"<div><p>{long}</p></div>{links}<div><p>{other}</p></div>") == long.strip()


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='header-fixed'", "form id=page"])
def test_an_article_in_a_wrapper_that_looks_like_chrome(wrapper):
    page = f"<body><{wrapper}><div class=menu>Menu</div>%s<p>out</p></{wrapper.split()[0]}></body>"
    assert H.main_text(page % "<main><p>in</p><div class=share>Share</div></main>") == "in"
    assert H.main_text(page % "<article><p>in</p></article>") == "in"


@pytest.mark.parametrize("wrapper", ["div class=related-posts", "div class=comments", "aside", "nav"])
def test_articles_of_other_parts_stay_out(wrapper):
    assert H.main_text(f"<article><p>in</p></article><{wrapper}><article><p>some other and longer text</p></article></{wrapper.split()[0]}>") == "in"


@pytest.mark.parametrize(
    "part",
    ["<h2 id='discussion'>x</h2>", "<h2 id=related>x</h2>", "<section id='search'><p>x</p></section>", "<p class='tags'>x</p>", "<div class='related-work'>x</div>", "<p class=alert>x</p>", "<math><mi>x</mi></math>", "<div class=search>x <a>y</a></div>"],
)
def test_article_text_is_not_chrome_by_a_word(part):
    [line] = H.main_text(f"<article><p>one</p>{part}<p>two</p></article>").split("\n")[1:-1]
    assert line in ("x", "x y")


@pytest.mark.parametrize("part", ["<p hidden>x</p>", "<p aria-hidden=true>x</p>", "<div class='ad-box'>x</div>", "<ul class='share-buttons'><li>x</ul>", "<div class=related>See <a href=1>the other thing</a></div>", "<p class=tags><a>a</a> <a>b</a></p>", "<section class='comments'><p>x</p></section>", "<form>x</form>", "<aside>x</aside>"])
def test_chrome_inside_an_article(part):
    assert H.main_text(f"<article><p>one</p>{part}<p>two</p></article>") == "one\ntwo"


def test_links_belong_to_an_article():
    assert H.main_text("<article><p>one</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p><a>two</a></p></article><p><a>out</a></p>") == "one\na\nb\nc\nd\ntwo"


def test_the_distribution_decides_against_a_name():
    """Teasers that name themselves articles beside the text that makes up the page."""
    long = ["A long paragraph with many words in it. " * 4, "Another one with words of its own. " * 4, "And a third one that ends the text. " * 4]
    teasers = "".join(f"<article><a href={i}>Teaser {i}</a></article>" for i in range(3))
    assert H.main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in long * 3)}</div>{teasers}</body>").split("\n")[:3] == [x.strip() for x in long]


def brute_article(page):
    """An article's text by cutting the page at its tags, for pages whose article holds no chrome."""
    inner = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", page, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:h[1-6]|p|br|ul|li|div|blockquote)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    from tidemark.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op3_html_extraction"](spark, folder).collect()
    assert {r["page_id"] for r in found} == pages.keys()
    for r in found:
        assert r["text"] == brute_article(pages[r["page_id"]]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "part",
    ["<h2 id='discussion'>x</h2>", "<h2 id=related>x</h2>", "<section id='search'><p>x</p></section>", "<p class='tags'>x</p>", "<div class='related-work'>x</div>", "<p class=alert>x</p>", "<math><mi>x</mi></math>", "<div class=search>x <a>y</a></div>"],
)
def test_article_text_is_not_chrome_by_a_word(part):
    [line] = H.main_text(f"<article><p>one</p>{part}<p>two</p></article>").split("\n")[1:-1]
    assert line in ("x", "x y")


@pytest.mark.parametrize("part", ["<p hidden>x</p>", "<p aria-hidden=true>x</p>", "<div class='ad-box'>x</div>", "<ul class='share-buttons'><li>x</ul>", "<div class=related>See <a href=1>the other thing</a></div>", "<p class=tags><a>a</a> <a>b</a></p>", "<section class='comments'><p>x</p></section>", "<form>x</form>", "<aside>x</aside>"])
def test_chrome_inside_an_article(part):
    assert H.main_text(f"<article><p>one</p>{part}<p>two</p></article>") == "one\ntwo"


def test_links_belong_to_an_article():
    assert H.main_text("<article><p>one</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p><a>two</a></p></article><p><a>out</a></p>") == "one\na\nb\nc\nd\ntwo"


def test_the_distribution_decides_against_a_name():
    """Teasers that name themselves articles beside the text that makes up the page."""
    long = ["A long paragraph with many words in it. " * 4, "Another one with words of its own. " * 4, "And a third one that ends the text. " * 4]
    teasers = "".join(f"<article><a href={i}>Teaser {i}</a></article>" for i in range(3))
    assert H.main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in long * 3)}</div>{teasers}</body>").split("\n")[:3] == [x.strip() for x in long]


def brute_article(page):
    """An article's text by cutting the page at its tags, for pages whose article holds no chrome."""
    inner = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", page, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:h[1-6]|p|br|ul|li|div|blockquote)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    from tidemark.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op3_html_extraction"](spark, folder).collect()
    assert {r["page_id"] for r in found} == pages.keys()
    for r in found:
        assert r["text"] == brute_article(pages[r["page_id"]]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_stretch():
    assert H.stretch([0, 0, 50, 60, 0, 40, 0, 0, 0, 0, 45]) == (0, 6)
    assert H.stretch([0, 1, 2]) == (0, 0)


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain", "plain"), ("<p>a < b & c &lt;i&gt; &amp;amp;</p>", "a < b & c <i> &amp;"), ("<script>x</script>", ""), ("<p>x<!-- <p>no</p> --> y</p>", "x y"), ("<article></article>", ""), ("<main><p>in</main><p>out</p>", "in")])
def test_small_pages(page, text):
    assert H.main_text(page) == text


def test_broken_pages_take_linear_time():
    began = time.monotonic()
    for bad in ("<a " * 60_000, '<a "' * 60_000 + ">", "<" * 300_000, "<div>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<p>" * 100_000, "<!--" * 60_000, "<script>" * 50_000):
        H.main_text(bad)
    assert time.monotonic() - began < 20


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<article>" + "<p>Word of the page. </p>" * 20_000 + "</article>"
    same = "x" * 100
    rows = [(5, "http://a.org/", same), (3, "http://b.org/", same), (9, None, same), (1, "no scheme", None), (2, "http://c.com/de/x y", ""), (4, "http://d.com/", "y" * 99), (6, "http://d.com/", "y" * 99), (7, "http://e.net/\n", big), (7, "http://e.net/\n", big), (8, "http://é.org/", "é" * 60), (None, "http://f.org/", same)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "host", "text", "warc", "_id", "first")})


def test_extract_odd_rows(odd_pages):
    found = H.extract(odd_pages).collect()
    assert len(found) == 11
    by = {r["page_id"]: r for r in found}
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0 and by[2]["text"] == ""
    assert by[7]["text"].count("\n") == 19_999 and by[7]["n_chars"] == len(by[7]["text"])
    assert H.extract(odd_pages.limit(0)).count() == 0


def test_extract_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        text = found[r["page_id"]]
        assert text and "track(" not in text and "<p>" not in text
        assert text.split("\n")[0][:20] in __import__("html").unescape(article)


# --- archives


def test_both_versions_parse():
    for version in (1, 2):
        records = [("http://a.org/x y", b"<p>one</p>\nURL"), ("http://b.org/", b""), ("", b"\n\n")]
        data = A.arc_header(version) + b"".join(A.arc_record(version, u, p) for u, p in records)
        parsed = list(A.parse_arc(data))
        assert [r.payload for r in parsed] == [p for _, p in records]
        assert [r.url for r in parsed] == ["http://a.org/x%20y", "http://b.org/", "about:blank"]
        with pytest.raises(A.ArchiveError):
            list(A.parse_arc(data[:-3]))
    with pytest.raises(A.ArchiveError):
        list(A.parse_arc(b"http://a.org/ 0.0.0.0 20240101000000 text/html 1\nx\n"))


def test_warc_record_fields():
    record = A.ArcRecord("http://a.org/", "1.2.3.4", "20240506070809", "text/html", 200, b"x\r\n\r\ny")
    data = A.warc_record(record, hashlib.sha256(record.payload).hexdigest(), "7")
    [(head, block)] = A.parse_warc(data)
    assert head["WARC-Date"] == "2024-05-06T07:08:09Z" and head["WARC-Type"] == "response" and head["WARC-Record-ID"] == A.record_id("7")
    assert block.partition(b"\r\n\r\n")[2] == record.payload
    [(head, block)] = A.parse_warc(A.warc_record(record, "d", "8", "7"))
    assert head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == A.record_id("7") and block.endswith(b"\r\n\r\n")
    with pytest.raises(A.ArchiveError):
        list(A.parse_warc(data[:-5]))


def test_round_trip_of_odd_rows(odd_pages):
    found = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in A.round_trip(odd_pages).collect()))
    big = odd_pages.where("page_id = 7").first()["html"]
    assert found == [(-1, "response", None, 100), (1, "response", None, 0), (2, "response", None, 0), (3, "response", None, 100), (4, "response", None, 99), (5, "revisit", 3, 100), (6, "response", None, 99), (7, "response", None, len(big)), (7, "response", None, len(big)), (8, "response", None, 120), (9, "revisit", 3, 100)]
    assert A.round_trip(odd_pages.limit(0)).count() == 0


def test_records_have_dates_and_archives_their_description(odd_pages):
    from datetime import datetime, timedelta

    archives = A.convert(A.plan_revisits(odd_pages))
    for r in archives.collect():
        records = list(A.parse_warc(bytes(r["warc"])))
        assert [h["WARC-Type"] for h, _ in records].count("warcinfo") == 1 and records[0][0]["WARC-Type"] == "warcinfo"
        assert len({h["WARC-Record-ID"] for h, _ in records if h.get("X-Source-Key") not in ("", "7")}) == sum(h.get("X-Source-Key") not in ("", "7") for h, _ in records)
    for r in A.round_trip(odd_pages).collect():
        assert r["warc_date"] == (datetime(2024, 1, 1) + timedelta(seconds=r["page_id"] or 0)).isoformat() + "Z"
        assert r["record_id"] == A.record_id("" if r["page_id"] is None else str(r["page_id"]))
    assert A.iso_date("199912312359") == "1999-12-31T23:59:00Z"


def test_digests_are_of_the_payload(odd_pages):
    want = {r["page_id"]: hashlib.sha256((r["html"] or "").encode()).hexdigest() for r in odd_pages.collect()}
    assert {r["page_id"]: r["payload_digest"] for r in A.round_trip(odd_pages).collect()} == want


# --- URLs


def brute_verdict(url, rules=U.RULES, blocked=U.BLOCKED_HOSTS, labels=U.BLOCKED_LABELS):
    host, path = U.split_url(url)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return best
    return None, "block" if any(host == b or host.endswith("." + b) for b in blocked) or set(host.split(".")) & set(labels) else "allow"


@pytest.mark.parametrize(
    ("url", "cut"),
    [(None, ("", "")), ("", ("", "")), ("a.org/x", ("", "")), ("http://A.Org", ("a.org", "")), ("http://a.org?x=/y", ("a.org", "")), ("http://a.org#/y", ("a.org", "")), ("HTTP://É.ORG/P?q#f", ("É.org", "/P")), ("x://y://z/w", ("y:", "//z/w")), ("://", ("", ""))],
)
def test_split(url, cut):
    assert U.split_url(url) == cut


@pytest.mark.parametrize("most", [U.MAX_ENTRIES, 3])
def test_verdicts_against_brute_force(spark, monkeypatch, most):
    """By the array and, for lists over the bound, by a join: the same rows."""
    import random

    monkeypatch.setattr(U, "MAX_ENTRIES", most)
    draw = random.Random(4)
    hosts = ["example.org", "www.example.org", "xexample.org", "a.com", "com", "org", "adult-x.example.com", "m.adult-x.example.com", ".org", "a..org", "b.net", "Bad.Host.net", "x.bad.host.net"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x", "/FR/", "?/fr/", "#x"]
    urls = [f"http://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(500)] + [None, "nothing", None]
    rows = [(i if i % 50 else 7, u) for i, u in enumerate(urls)]  # repeated ids with other urls
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for blocked in (["Bad.host.net"], spark.createDataFrame([("bad.host.net",), (None,)], "name string")):
        found = U.verdicts(pages, blocked=blocked).collect()
        assert sorted((r["page_id"], str(r["url"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in found) == sorted((i, str(u), *U.split_url(u), *map(str, brute_verdict(u, blocked=["bad.host.net"]))) for i, u in rows)


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(M.xxhash, "xxh3_64_intdigest", lambda data: len(data) % 2)
    array = M.DigestArray(M.DigestArray.arrays([(b"aa", 1), (b"bb", 0), (b"c", 1)]))
    assert array.find([b"aa", b"bb", b"cc", b"c", b"d"]) == [1, 0, -1, 1, -1]
    assert M.DigestArray(M.DigestArray.arrays([])).find([b"a"]) == [-1]


@pytest.mark.parametrize("most", [U.MAX_ENTRIES, 3])
def test_labels_block_under_every_ending(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_ENTRIES", most)
    want = {"http://m.casino-win.example.com/x": "block", "http://Casino-Win.example.net": "block", "http://casino-win.b.net/": "block", "http://xcasino-win.example.com/": "allow", "http://casino-win.example.org/": "allow", "http://b.net/casino-win": "allow"}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    found = U.verdicts(pages, labels=["Casino-win"]).collect()
    assert {r["url"]: r["verdict"] for r in found} == want
    assert {r["url"]: r["rule"] for r in found if r["rule"]} == {"http://casino-win.example.org/": "org/"}


@pytest.mark.parametrize("most", [U.MAX_ENTRIES, 3])
def test_odd_urls(odd_pages, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_ENTRIES", most)
    found = U.verdicts(odd_pages).collect()
    assert len(found) == 11 and {r["verdict"] for r in found} <= {"allow", "block"}
    assert U.verdicts(odd_pages.limit(0)).count() == 0
