"""Page extraction: blocks, chrome, differencing against brute force, odd rows, the query against the documents."""

import random
import re

from moodspark.llm import page_text, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, lines string, host int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def texts(html):
    return [x for x, _ in page_text.page_lines(html)]


def test_blocks_and_chrome():
    html = """<!doctype html><html><head><title>T</title><style>p{x}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Menu</nav><div class="cookieNotice">We use cookies</div>
    <main><article><header><h1>Head &amp; tail</h1></header><p>One  <b>two</b>\n three<p>Fo<i>ur</i>&nbsp;&#233;
    <script>if (a < b) document.write("<p>no</p>")</script><ul><li>five<li>six</ul><table><tr><td>7</td><td>8</td></tr>
    </table><aside>Aside</aside><form><input>Send</form></article>
    <section id="comments"><p>First!</p></section></main><!-- <p>gone</p> --><div style="display: none">x</div>
    <div class="ad-box">Buy</div><footer>(c)</footer></body></html>"""
    assert texts(html) == ["Head & tail", "One two three", "Four é", "five", "six", "7", "8"]


def test_broken_markup_does_not_fail():
    for html in (None, "", "plain", "<p>a<b>b</p>c</i></b></p>", "<<>>< p>x", "<p title='>'>y</p", "<article><p>z",
                 "</div>" * 9 + "q", "<div>" * 4000 + "deep" + "</div>" * 4000, "<![CDATA[x]]>", "<p>" + "w " * 200_000):
        page_text.page_lines(html)
    assert texts("<p>a<b>b</p>c</i></b></p>") == ["ab", "c"]


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(1)

    def longest(a, b):
        best = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[-1][j] + 1 if x == y else max(best[-1][j + 1], row[j]))
            best.append(row)
        return best[-1][-1]

    for _ in range(500):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 9))] for _ in range(2))
        found, rest = page_text.common_lines(a, b), iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


def test_shared_lines_of_the_nearest_path_are_deleted(spark):
    def page(story, extra=""):
        return f"<div>Welcome</div><div>{story}</div><div>Read on</div>{extra}<div>All rights</div>"

    rows = [(k, f"https://a.example/news/{k:04}/", page(f"story {k}", "<p>Welcome</p>" if k == 3 else ""))
            for k in range(1100)]
    rows += [(5000, "https://b.example/x", page("alone")), (5001, "http://a.example/news/0003?page=2", page("story 3")),
             (5002, "https://c.example/1", "<article><p>quoted</p></article><p>Footer</p>"),
             (5003, "https://c.example/2", "<article><p>quoted</p></article><p>Footer</p>"),
             (5004, "https://d.example/1", "<p>copy</p>"), (5005, "https://d.example/2", "<p>copy</p>"),
             (5006, None, "<p>no address</p>"), (None, "not a url", None), (5007, "http://[bad", "<p>q</p>")]
    got = {r.page_id: r for r in page_text.extract_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == f"story {k}" for k in range(1100) if k != 3)
    assert got[3].text == "story 3\nWelcome" and got[5001].text == "story 3"
    assert got[5000].text == "Welcome\nalone\nRead on\nAll rights"
    assert got[5002].text == got[5003].text == "quoted"
    assert got[5004].text == got[5005].text == "copy"
    assert got[5006].text == "no address" and (got[None].text, got[None].n_chars) == ("", 0)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://a/x", "<p>😀 a</p>")] * 3
    got = page_text.extract_text(pages(spark, rows)).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "http://a/x", "😀 a", 3)] * 3
    assert page_text.extract_text(pages(spark, [])).count() == 0


def test_query_gives_the_documents_that_the_pages_show(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op1(spark, SF).collect()
    assert len(got) == queries.table(spark, SF, "pages").count()
    for r in got:
        lines = [" ".join(x.split()) for x in docs[int(re.search(r"/(\d+)", r.url)[1])].split("\n") if x.split()]
        assert r.text.split("\n")[1:] == lines and r.n_chars == len(r.text)
