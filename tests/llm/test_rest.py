"""Chat formatting, HTML extraction, the pipeline and the registry."""

import random
import time
from hashlib import sha256

import duckdb
import pytest

from marlstone.llm import chat_format, html_text, registry
from tests.test_catalog import TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(c.execute(registry.oracle_sql()[name]).df())


NASTY = ["", "<|end|>\n", "<|>end\n", "<|>+", "+", "end\n", ">", "\\r", "\\", "\\l", "\\b<|", "<|user|>", "<", "|>", "<|+|>", "a<", "|b", "$1 \\1", "é😀", "</s>[INST]"]


def test_formatting_reads_back(spark):
    r = random.Random(1)
    data = []
    for conv in range(60):
        for turn in range(r.randint(1, 8)):
            data.append((conv, turn, r.choice(["user", "assistant", "assistant", "we|>ird<|\\", None, ">", ">user", ">x", "|", "<", "x<", "end", "+", "|>", "\\r", "\\b"]), "".join(r.choice(NASTY) for _ in range(r.randint(0, 4))) if r.random() < 0.9 else None, "x"))
    data += [(70, None, "user", "first", "x"), (70, 1, "user", "second", "x"), (70, 1, "user", "second", "x"), (None, 0, "assistant", "no id", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in {d[0] for d in data}:
        want = sorted(((d[1] is not None, d[1] or 0, d[2] or "", d[3] or "") for d in data if d[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(w[2], w[3]) for w in want]
        assert all(t.in_loss == (t.role == "assistant") for t in got[conv].turns)
        runs = 1 + sum(a[2] != b[2] for a, b in zip(want, want[1:]))
        assert got[conv].formatted.count("<|>end\n") == runs


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(df)).count() == 0


HTML = [
    (None, ""), ("", ""), ("plain <b>bold</b>\n text", "plain bold text"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"), ("<script>no</script><style>no</style><div hidden>no</div><p style='color:red; display: none'>no</p>yes", "yes"),
    ("<table><tr><th>Name<th>Age<tr><td>Bob<td>42</table>", "Name  Age\nBob   42"), ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x  y\n   z"), ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
    ("<pre>\n a\n   b</pre>", " a\n   b"), ("<!-- <p>no</p> -->x &amp; y &lt;z&gt; &#233;", "x & y <z> é"), ("<p>unclosed <b>tags <i>here", "unclosed tags here"), ("a < b and c > d", "a < b and c > d"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<head><title>no</title></head><body>yes</body>", "yes"), ("<select><option>a<option>b</select>", "a\nb"), ("<div><p>in</div>out", "in\n\nout"), ("<a href='x>y'>link</a>", "link"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"), ("<div style='visibility:hidden'><p>no<p style='visibility:visible'>a<span style='display:none'>no</span>b</div>", "ab"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "yes"), ("<details><summary>more</summary><p>no</details><details open><summary>all</summary><p>yes</details>", "more\nall\n\nyes"),
    ("<table><tfoot><tr><td>sum</tfoot><thead><tr><td>head</thead><tbody><tr><td>row</table>", "head\nrow\nsum"), ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<svg><title>no</title><defs/><style/><text>one</text><text>two</text></svg><math><mi>x</mi></math><map><area>in a map</map>", "one\ntwo\nxin a map"), ("<p don't>a</p><p title=\"x>y\">b<p t='>c", "a\n\nb\n\nc"),
    ("<!-->a<!--->b<!-- x --!>c</>d</ e>f<?g>h", "abcdfh"), ("<p>kept<p class='no", "kept"), ("<div popover>no</div><div hidden=until-found>no</div>x<", "x<"), ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
]


@pytest.mark.parametrize("html,want", HTML, ids=range(len(HTML)))
def test_layout(html, want):
    assert html_text.extract(html) == want


def test_deep_and_broken_pages():
    assert html_text.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    for n in (300, 340, 399, 5000):
        assert html_text.extract("<table>" * n + "x").strip() == "x"
        assert html_text.extract("<table><tr><td>" * n + "x").strip() == "x"
    r = random.Random(2)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<", ">", "<!--", "-->", "text ", "&amp", "<pre>", "\n", "<b", "</", "<td colspan=9>", "<script>", "<textarea>"]
    for _ in range(2000):
        html_text.extract("".join(r.choice(parts) for _ in range(r.randint(0, 40))))


HOSTILE = {
    "open tags": "<a " * 350_000, "quotes": "<a b='>" * 150_000, "quoted ends": '<a b=">"' * 130_000, "comments": "<!--" * 250_000, "brackets": "<" * 1_000_000, "spans": "<table>" + ("<tr>" + "<td rowspan=1000 colspan=1000>x" * 600) * 50,
    "wide row": "<table><tr>" + "<td>x" * 200_000, "long cell": "<table>" + "<tr><td>" + "y" * 500_000 + "<td>z" + "<tr><td>a<td>b" * 30_000, "tall span": "<table><tr><td colspan=1000 rowspan=60000>" + "<tr><td>a" * 100_000,
    "lists": "<ul><li>" * 100_000 + "x", "far column": "<table>" + "<tr><td colspan=255>a<td>b" * 30_000, "lines": "<table><tr>" + "<td>" + "<br>" * 100_000 + "<td>x" * 100_000, "entities": "&amp" * 250_000, "raw": "<script>" * 100_000, "ends": "</p>" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_hostile_page_takes_time_in_proportion(name):
    began = time.process_time()
    out = html_text.extract(HOSTILE[name])
    assert time.process_time() - began < 20 and len(out) < 60 * len(HOSTILE[name])


def plain_page(r, depth=0):
    """A random page and its lines, each block of which says how many blank lines it asks for around it."""
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 7)))
    html, blocks = "", []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["p", "div", "ul", "ol", "table", "h2", "pre"] if depth < 2 else ["p", "div"])
        hide = r.random() < 0.1
        attr = r.choice([" hidden", " style='display:none'"]) if hide else ""
        if kind in ("ul", "ol"):
            inner, lines = "", []
            for k in range(r.randint(1, 3)):
                t = " ".join(word() for _ in range(r.randint(1, 4)))
                inner += f"<li>{t}" + r.choice(["</li>", ""])
                lines.append((f"{k + 1}. " if kind == "ol" else "- ") + t)
            got = f"<{kind}{attr}>{inner}</{kind}>", lines, 1
        elif kind == "table":
            rows_ = [[word() for _ in range(3)] for _ in range(r.randint(1, 3))]
            width = [max(len(x[c]) for x in rows_) for c in range(3)]
            inner = "".join("<tr>" + "".join(f"<td>{c}" for c in x) for x in rows_)
            got = f"<table{attr}>{inner}</table>", ["  ".join(c.ljust(w) for c, w in zip(x, width)).rstrip() for x in rows_], 1
        elif kind == "pre":
            lines = [word() + "   " + word() for _ in range(r.randint(1, 3))]
            got = f"<pre{attr}>" + "\n".join(lines) + "</pre>", lines, 1
        else:
            t = " ".join(word() for _ in range(r.randint(1, 5)))
            got = f"<{kind}{attr}>{t.replace(' ', r.choice([' ', chr(10), '  ']))}</{kind}>", [t], 0 if kind == "div" else 1
        html += got[0]
        if not hide:
            blocks.append(got[1:])
    return html, blocks


def test_layout_of_random_pages():
    r = random.Random(12)
    for _ in range(1500):
        html, blocks = plain_page(r)
        want: list[str] = []
        gap = 0
        for lines, around in blocks:
            if want:
                want += [""] * max(gap, around)
            want += lines
            gap = around
        assert html_text.extract(html) == "\n".join(want), html


def test_all_visible_words_come_out(spark, sf):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    got = {r.page_id: r for r in html_text.op6_html_text(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        w = Words()
        w.feed(p.html)
        # bullets and numbers of lists are the rendering's own
        mine = "".join(line.removeprefix("- ") for line in got[p.page_id].text.split("\n"))
        assert "".join(mine.split()) == "".join("".join(w.out).split())
        assert got[p.page_id].text_sha256 == sha256(got[p.page_id].text.encode()).hexdigest()


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(1, "<p>x", "u", "t"), (1, "<p>x", "u", "t"), (None, None, None, None)], "page_id long, html string, url string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in html_text.extract_pages(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_pipeline(spark, sf, edge):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, edge, sf)
        assert out.columns == edge.columns and out.count() <= edge.count(), k
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() <= docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
