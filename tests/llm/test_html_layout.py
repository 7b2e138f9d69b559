"""Rendering of pages, case by case and against a plain reading of the test pages."""

import html
import os
import random
import re
import time

import pytest

from meterbook.llm import html_layout as op
from meterbook.llm import queries

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<h1>T</h1><p>x <b>y</b>z</p>", "T\n\nx yz"),
    ("a  \n b<br>c<br/>d", "a b\nc\nd"),
    ("<p>a <!-- no --><script>var t='</p>'</script>b", "a b"),
    ("<title>no</title><body>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a</li><li>b</li><li value=20>c</ol>", "9. a\n10. b\n20. c"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("<table><tr><th>a<th>long head<tr><td>bbb<td>c</table>", "a    long head\nbbb  c"),
    ("<table><caption>cap</caption><tr><td rowspan=2>x<td>1<tr><td>2</table>", "cap\nx  1\n   2"),
    ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<table><tr><td><p>p<p>q<td>r</table>after", "p  r\n\nq\n\nafter"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ("<style>.ad,p#x{display:none}</style><div class='big ad'>no</div><p id=x>no<p>yes", "yes"),
    ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<blockquote>a<p>b</blockquote>c", "  a\n\n  b\n\nc"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("</p></b>a</div>", "a"),
    ("a < b <", "a < b <"),
    ("<p>open <a href='x>y'>link</a", "open link"),
    ("<ul><li></ul>x", "-\n\nx"),
    ("<table><tr><td colspan=2>Hi</table>", "Hi"),
    ("<table><tr><td colspan=2>a<td>b</table>", "a  b"),
    ("<table><tr><td>a<td colspan=3>long text<td>b<tr><td><td>c</table>", "a  long text  b\n   c"),
    ("<style>.tab{display:none} .tab.active{display:block}</style><p class=tab>no<p class='active tab'>yes", "yes"),
    ("<style>@media print{p{display:none}} @media (max-width: 400px){p{display:none}}</style><p>yes", "yes"),
    ("<style>@media screen and (min-width:600px){p{display:none}}</style><p>no", ""),
    ("<style>.a .b{display:none} .a > i{visibility:hidden}</style><div class=a><p><span class=b>no</span><i>yes</i></p><i>no</i></div><span class=b>yes", "yes\n\nyes"),
    ("<style>.v{visibility:hidden} p{display:none !important}</style><p style='display:block'>no</p><b class=v>no</b>yes", "yes"),
    ("<select><option>a<option>b</select><textarea> c\n d</textarea><svg><title>no</title><text>e</text></svg>", "a\nb\n c\n de"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert op.render(page) == text


def test_deep_and_long_pages():
    assert op.render("<div>" * 20_000 + "x") == "x"
    assert op.render("<p>w" * 20_000).count("w") == 20_000


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", 1), (1, "<p>a", 1), (None, None, 2)], "page_id bigint, html string, text int")
    assert sorted(map(tuple, op.extract(pages).collect()), key=repr) == sorted([(1, "a"), (1, "a"), (None, "")], key=repr)
    assert op.extract(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables are not there")
def test_words_of_the_test_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in queries.QUERIES["op4_html_layout"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        body = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r.html)
        plain = html.unescape(re.sub(r"(?s)</?(?:b|i|em|a|span|strong)\b[^>]*>", "", body))
        want = re.sub(r"(?s)<[A-Za-z/!][^>]*>", " ", plain).split()
        drop = {"-", "---"}
        assert [w for w in got[r.page_id].split() if w not in drop] == [w for w in want if w not in drop], r.page_id


def test_cells_of_any_span_keep_words_apart():
    rng = random.Random(7)
    for _ in range(1500):
        words, page = [], "<table>"
        for _ in range(rng.randint(1, 4)):
            page += "<tr>"
            for _ in range(rng.randint(0, 4)):
                own = [f"w{len(words) + i}" * rng.randint(1, 4) for i in range(rng.randint(0, 2))]
                words += own
                page += f"<td colspan={rng.randint(0, 4)} rowspan={rng.randint(0, 3)}>{rng.choice([' ', '<br>']).join(own)}"
        assert sorted(op.render(page + "</table>").split()) == sorted(words), page


def test_long_style_text_is_read_in_passing():
    for sheet in ("x" * 1_000_000, "/*" + "a" * 500_000, "{" * 300_000, "a{" * 200_000 + "}" * 200_000, "p{display:none}" * 50_000 + "b" * 500_000):
        begun = time.perf_counter()
        assert "seen" in op.render(f"<style>{sheet}</style><div>seen</div>")
        assert time.perf_counter() - begun < 5
