import pytest
from pyspark.sql import functions as F

from labelspark.operators import links
from labelspark.plans import jobs

E = "https://example.com/"
# (href, text, title, aria label, alt) -> expected [(href tail, type, score)]
SCORED = [
    ([("stromkennzeichnung-2024.pdf", "Herunterladen", "", "", "")], [("stromkennzeichnung-2024.pdf", "pdf", 80)]),
    ([("skz-2024.png", "stromkennzeichnung energy trading 2024", "", "", "")], [("skz-2024.png", "image", 50)]),
    ([("stromkennzeichnung.png", "Stromkennzeichnung Bild", "", "", ""), ("stromkennzeichnung.pdf", "Stromkennzeichnung PDF", "", "", "")],
     [("stromkennzeichnung.pdf", "pdf", 100), ("stromkennzeichnung.png", "image", 80)]),
    ([("stromkennzeichnung.html", "Stromkennzeichnung", "", "", ""), ("stromkennzeichnung.zip", "x", "", "", ""), ("about", "Über uns", "", "", "")], []),
    ([("jahresbericht-2024.pdf", "Jahresbericht herunterladen", "", "", ""), ("faq-fernsteuerung.pdf", "FAQ", "", "", "")], []),
    ([("download/2024.pdf", "Herunterladen", "stromkennzeichnung 2024", "", "")], [("download/2024.pdf", "pdf", 50)]),
    ([("download/2024.png", "", "", "stromkennzeichnung als bild", "")], [("download/2024.png", "image", 30)]),
    ([("logo-stromkennzeichnung.png", "Logo", "", "", ""), ("icon-energiemix.jpg", "Icon", "", "", "")], []),
    ([("stromkennzeichnung.pdf", "Link 1", "", "", ""), ("stromkennzeichnung.pdf", "stromkennzeichnung download", "", "", "")],
     [("stromkennzeichnung.pdf", "pdf", 100)]),
    ([("stromkennzeichnung.jpg", "SKZ", "", "", ""), ("energiemix.jpeg", "Energiemix", "", "", "")],
     [("energiemix.jpeg", "image", 60), ("stromkennzeichnung.jpg", "image", 60)]),
    ([("stromkennzeichnung.pdf?v=2&t=123", "Download", "", "", "")], [("stromkennzeichnung.pdf?v=2&t=123", "pdf", 80)]),
    ([("x.png", "", "", "", "strommix")], [("x.png", "image", 50)]),
]


def test_document_link_scores(spark):
    rows = [(case, i, E + l[0], *l[1:]) for case, (given, _) in enumerate(SCORED) for i, l in enumerate(given)]
    df = spark.createDataFrame(rows, "page_id long, position int, href string, text string, title string, aria_label string, alt string")
    got = {}
    for r in links.score_document_links(df).collect():
        got.setdefault(r.page_id, []).append((r.url.removeprefix(E), r.type, r.score))
    for case, (_, want) in enumerate(SCORED):
        assert sorted(got.get(case, [])) == sorted(want), case


RANKED = [
    ("Adolf Roth GmbH & Co. KG Stromkennzeichnung PDF",
     ["https://www.roth-energie.de/stromkennzeichnung.pdf", "https://www.generic.de/document.pdf"], [0]),
    ("Werraenergie GmbH Stromkennzeichnung",
     ["https://gemeindestrom.de/uploads/Stromkennzeichnung-2025.pdf",
      "https://www.werraenergie.de/documents/6112312/Strommix+ab+01.07.2026.pdf/a979806e-1b01?download=true", "https://www.werraenergie.de/"], [1, 2]),
    ("Vonovia Energie GmbH Stromkennzeichnung",
     ["https://www.ewagkamenz.de/044-1-Stromkennzeichnung.pdf", "https://www.energie.vonovia.de/"], [1]),
    ("Adolf Roth GmbH & Co. KG Stromkennzeichnung",
     ["https://8485739.fs1.hubspotusercontent-eu1.net/hubfs/8485739/ROTH Energie/Stromkennzeichnung_2023.pdf",
      "https://www.stadtwerke-irgendwo.de/stromkennzeichnung.pdf"], [0]),
    ("Voltego GmbH Stromkennzeichnung",
     ["https://www.fremdes-stadtwerk.de/stromkennzeichnung.pdf", "https://www.anderes-ewerk.de/energiemix.pdf"], []),
    ("24/7 Strom GmbH Stromkennzeichnung", ["https://www.beispiel-energie.de/stromkennzeichnung.pdf"], [0]),
    ("Voltego GmbH Stromkennzeichnung",
     ["https://www.northdata.de/Voltego GmbH, Krefeld/HRB 17514", "https://duckduckgo.com/y.js?ad_domain=unsubby.com&u3=https://www.bing.com/aclick",
      "https://www.provenexpert.com/de-de/voltego-gmbh/", "https://www.voltego.de/stromkennzeichnung"], [3]),
]


def test_search_result_ranking(spark):
    rows = [(case, i, u, q) for case, (q, given, _) in enumerate(RANKED) for i, u in enumerate(given)]
    df = spark.createDataFrame(rows, "provider_id long, position int, url string, query string")
    ranked = links.rank_search_results(df).collect()
    best = {r.provider_id: r.url for r in links.choose_source(df).collect()}
    for case, (_, given, want) in enumerate(RANKED):
        order = sorted((r for r in ranked if r.provider_id == case), key=lambda r: (-r.score, r.position))
        assert [r.url for r in order] == [given[i] for i in want], case
        assert best.get(case) == (given[want[0]] if want else None)
        assert not any("northdata" in r.url or "duckduckgo" in r.url for r in order)


PAGE = """<html><head><title>t</title><script>var a='<a href="/no">no</a>';</script></head><body>
<!-- <a href="/hidden">x</a> -->
<A class=x HREF='sub/../Strom mix.pdf?a=1&amp;b=2&copy=3'> Strom&shy;mix <b>&Uuml;ber</b></A>
<a href="//cdn.net/x">offen <a href=/energiemix.pdf title="Energiemix &quot;24&quot;">zwei</a>
<a name="anchor">kein Link</a><a href="mailto:a@b.de">Post</a><a href="#oben">oben</a>
<img src="/i/strommix.png" alt="Strommix"><img alt="leer"></body></html>"""


def test_page_links(spark):
    df = spark.createDataFrame([(1, "https://www.x.de/de/seite?q=1", PAGE)], "page_id long, url string, html string")
    got = [(r.href, r.text, r.title, r.alt, r.kind) for r in links.page_links(df).orderBy("position").collect()]
    assert got == [
        ("https://www.x.de/de/Strom%20mix.pdf?a=1&b=2&copy=3", "strom\xadmix über", "", "", "a"),
        ("https://cdn.net/x", "offen", "", "", "a"),
        ("https://www.x.de/energiemix.pdf", "zwei", 'energiemix "24"', "", "a"),
        ("https://www.x.de/de/seite?q=1#oben", "oben", "", "", "a"),
        ("https://www.x.de/i/strommix.png", "", "", "strommix", "img"),
    ]


def test_link_selection_job(spark):
    df = spark.createDataFrame([(1, "https://www.x.de/de/", PAGE), (2, "https://y.de", "<p>nichts</p>")], "page_id long, url string, html string")
    got = jobs.link_selection(df).collect()
    assert [(r.page_id, r.url) for r in got] == [(1, "https://www.x.de/energiemix.pdf")]


@pytest.mark.parametrize("base,href,want", [
    ("https://x.de/a/b.html", "c.pdf", "https://x.de/a/c.pdf"),
    ("https://x.de", "c.pdf", "https://x.de/c.pdf"),
    ("https://x.de/a/b/", "../../../c", "https://x.de/c"),
    ("https://x.de/a/b/", "./", "https://x.de/a/b/"),
    ("https://x.de/a?x#y", "?z=1", "https://x.de/a?z=1"),
    ("https://x.de/a", "/é ö%20+", "https://x.de/%C3%A9%20%C3%B6%20+"),
])
def test_absolute(values, base, href, want):
    from labelspark.functions.markup import absolute, percent_encode, without_dots
    assert values(lambda b, h: percent_encode(without_dots(absolute(b, h))), [(base, href)], "b string, h string") == [want]


def test_page_text(spark):
    from labelspark.operators.text import page_text
    html = "<html><head><title>T</title></head><body><h1>Ein&nbsp;Titel</h1>\n<noscript>x</noscript><style>p{}</style><p>a&lt;b</p><p>c</p><!-- k --><script>if (a < b) {}</script> Ende <a href="
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert page_text(df).select("text").first()[0] == "Ein Titel a<bc Ende"
    assert page_text(df.withColumn("html", F.lit(None).cast("string"))).select("text").first()[0] is None


def test_odd_markup(spark):
    from labelspark.operators.links import page_links
    from labelspark.operators.text import page_text

    pages = [
        (1, '<head><title>T</title><body>Strommix 50 %'), (2, '<a title="a > b" href="/x.pdf">L</a>'),
        (3, '<a title="data href=/wrong.pdf" href="/right.pdf">L</a>'), (4, '<base target=x><base href="/sub/"><a href="y.pdf">L</a>'),
        (5, "<p>a <b title='x>y'>b</b> c <svg><title>d</title></svg>"), (6, '<p class="offen>text</p> mehr'), (7, '<a href=unquoted.pdf>L<a href="">M'),
        (8, "<head><script>var a = '</p>';</script><meta x>"), (9, "a < b & c"), (10, None), (11, ""), (12, "<head>" + "x" * 100_000), (13, "<p" + " a=b" * 100_000)]
    df = spark.createDataFrame([(i, "https://h.de/p/q.html", m) for i, m in pages], "page_id long, url string, html string")
    got = {}
    for r in page_links(df).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append(r.href)
    assert got == {2: ["https://h.de/x.pdf"], 3: ["https://h.de/right.pdf"], 4: ["https://h.de/sub/y.pdf"],
                   7: ["https://h.de/p/unquoted.pdf", "https://h.de/p/q.html"]}
    text = {r.page_id: r.text for r in page_text(df).collect()}
    assert [text[i] for i in (1, 2, 5, 9, 10, 11, 13)] == ["Strommix 50 %", "L", "a b c d", "a < b & c", None, "", ""]
    assert len(text[12]) == 100_000


TEXTS = [
    # comments end where a browser ends them
    ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!--x--!>b", "ab"), ("a<!-- > <b> -->b", "ab"), ("a<!-- offen", "a"), ("a<!doctype x>b<?php >c</>d", "abcd"),
    # raw text
    ("<head><script>var a = '</head>xy';</script></head>t", "t"), ("<style>a > b {}</style>t", "t"), ("<script>x</scripty></script >t", "t"),
    ("<noscript><p>x</noscript>t", "t"), ("<p><textarea><b>&amp;</textarea>c", "<b>&c"), ("<p><iframe><b></iframe>c", "<b>c"), ("x<plaintext><b>", "x<b>"),
    # a head that is not written
    ("<title>T</title><p>no head", "no head"), ("<meta x><link y> <title>T</title>\n<style>s</style>t", "t"), ("<p>a<title>T</title>", "aT"),
    ("<head><title>T</title><p>b", "b"), ("<template><p>no</template><p>b", "b"), ("<html><head></head><title>T</title><body>b", "b"),
    # attributes
    ("<p title='a > b'>t", "t"), ("<p a=b=\"c>t", "t"), ("<a ='x>y", "y"), ("<p title = \"a>b\"c='>'>t", "t"), ("<p class=\"offen>t</p> mehr", ""),
    ("a <b", "a"), ("a < b & c", "a < b & c"), ("&am<b></b>p;", "&amp;"), ("</p x='>'>t", "t"), ("<br/>t<x-y z>u", "tu"), ("a<", "a<"), ("a</", "a</"), ("</\u00e9>z", "z"),
]


def test_visible_text_of_odd_pages(spark):
    from labelspark.operators.text import page_text

    df = spark.createDataFrame(list(enumerate(t for t, _ in TEXTS)), "page_id int, html string")
    got = {r.page_id: r.text for r in page_text(df).collect()}
    assert [(TEXTS[i][0], got[i]) for i in range(len(TEXTS))] == TEXTS


LINKS = [
    ('<a href=" /c.pdf\n">x', "https://h.de/c.pdf"), ('<a href="\x01/a\tb\r\nc.pdf\x1f ">x', "https://h.de/abc.pdf"),
    ("<a title='x>y' href=/a.pdf>x", "https://h.de/a.pdf"), ("<a href=/a.pdf href=/b.pdf>x", "https://h.de/a.pdf"),
    ("<a HREF = '/a.pdf?x&amp;y&copy=1&reg'>x", "https://h.de/a.pdf?x&y&copy=1%C2%AE"), ("<!--><a href=/a.pdf>x", "https://h.de/a.pdf"),
    ("<script>'<a href=/no>'</script><a href=/a.pdf>x", "https://h.de/a.pdf"), ("<textarea><a href=/no></textarea><a href=/a.pdf>x", "https://h.de/a.pdf"),
    ("<base target=x><base href=' /sub/ '><a href=y.pdf>x", "https://h.de/sub/y.pdf"), ("<abbr href=/no><a href=/a.pdf/>x", "https://h.de/a.pdf/"),
    ('<a href="/a b.pdf">x', "https://h.de/a%20b.pdf"),
]


def test_addresses_of_odd_links(spark):
    df = spark.createDataFrame([(i, "https://h.de/p/q.html", m) for i, (m, _) in enumerate(LINKS)], "page_id int, url string, html string")
    got = {}
    for r in links.page_links(df).collect():
        got.setdefault(r.page_id, []).append(r.href)
        assert r.text == "x"
    assert [got.get(i) for i in range(len(LINKS))] == [[want] for _, want in LINKS]


def test_tokenizer_reads_once():
    """Pages made to be read again and again are read in linear time."""
    import time

    from labelspark.functions.markup import page_parts, visible_text

    start = time.time()
    for page in ("<" * 200_000, "<p x='" * 50_000, "<!--" * 100_000, "<a<" * 100_000, "<p a=" * 100_000, "<p" + " a=b" * 100_000, "<a href=x>" * 50_000,
                 "&" * 300_000, "<script>" * 50_000, "</" * 100_000, "<title>" * 50_000):
        visible_text(page)
        page_parts(page)
    assert time.time() - start < 20
