"""HTML extraction on hand-made pages with known answers (the parse library
of the reference is not available, so expected values are written out)."""

from pyspark.sql import functions as F

from docweave.functions.html_parse import parse_page
from docweave.operators import html as H

PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head>
<body><nav><ul><li><a href="/a">Home page</a></li><li><a href='/b'>HOME PAGE</a></li><li>ab</li></ul></nav>
<p>Click here for more help.</p>
<p>This is a long enough paragraph&nbsp;with an entity &amp; more.
<p>Second paragraph is unclosed but long enough to keep.</p>
<ol><li>outer item<ul><li>inner item</li></ul></li></ol>
<table><tr><td>Back</td><td>Forward</td></tr></table>
<table><tr><th>Types</th><th>Limits</th></tr><tr><td> Files </td><td>10</td></tr><tr><td>Rows</td><td></td></tr></table>
<!-- a comment --></body></html>"""


def test_parse_rules():
    p = parse_page(PAGE)
    texts = [n["text"] for n in p["nodes"]]
    assert not any("</p>" in t or "p{}" in t for t in texts)  # script/style skipped
    assert p["links"] == ["/a", "/b"]
    assert len(p["paras"]) == 3  # unclosed <p> closed by the next <p>
    assert "".join(p["paras"][1]).startswith("This is a long enough paragraph\xa0with an entity & more.")
    assert p["tables"][1] == [["Types", "Limits"], ["Files", "10"], ["Rows", ""]]
    kinds = [l["kind"] for l in p["lists"]]
    assert kinds == ["ul", "ol", "ul"]
    # the outer ol sees both items (nested text included); the inner ul its own
    assert ["".join(i).strip() for i in p["lists"][1]["items"]] == ["outer iteminner item", "inner item"]


def test_malformed_pages_do_not_fail():
    for html in ["", "<p>unclosed <b>bold", "</div></p>", "<table><td>x", None]:
        parse_page(html)


def _parsed(spark):
    df = spark.createDataFrame([(1, "/x/page.htm", PAGE)], "page_id long, url string, html string")
    return H.parse_pages(df)


def test_paragraphs_and_bullets(spark):
    r = _parsed(spark).select(
        H.paragraphs(F.col("paras")).alias("p"),
        H.list_bullets(F.col("lists"), F.col("stray_items")).alias("b"),
        H.table_text(F.col("tables")).alias("t"),
        H.visible_text(F.col("nodes"), " ", True).alias("v")).first()
    # the navigation paragraph ("help") is dropped, short ones too
    assert r.p.split("\n\n") == [
        "This is a long enough paragraph\xa0with an entity & more.",
        "Second paragraph is unclosed but long enough to keep."]
    # case-insensitive de-dup keeps the first; items of length <= 2 dropped;
    # the nested item appears inside the outer one and on its own
    assert r.b.split("\n") == ["• Home page", "• outer item inner item", "• inner item"]
    assert r.t == "Types | Limits\nFiles | 10\nRows |"
    assert r.v.startswith("T Home page HOME PAGE ab")


def test_table_grid(spark):
    r = _parsed(spark).select(H.tables_as_grids(F.col("tables")).alias("g")).first()
    assert r.g.split("\n") == [
        "+-------+--------+",
        "| Types | Limits |",
        "+=======+========+",
        "| Files | 10     |",
        "+-------+--------+",
        "| Rows  |        |",
        "+-------+--------+",
    ]


def test_page_document_full(spark):
    out = H.page_document_full(_parsed(spark)).first()
    assert out.block.startswith("===== FILE: /x/page.htm =====\n")
    assert "• Home page" in out.content and "Types | Limits" in out.content


def test_grid_drops_empty_and_navigation_tables(spark):
    html = ("<table><tr><td> </td><td></td></tr></table>"
            "<table><tr><td>Back</td><td>Forward</td></tr></table>"
            "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr><tr><td></td><td></td></tr></table>")
    df = spark.createDataFrame([(1, "/p.htm", html)], "page_id long, url string, html string")
    g = H.parse_pages(df).select(H.tables_as_grids(F.col("tables")).alias("g")).first().g
    assert g.split("\n") == ["+---+---+", "| A | B |", "+===+===+", "| 1 |   |", "+---+---+"]


def test_dedupe_first_wins_random(spark):
    import random
    random.seed(4)
    words = ["a", "A", " a", "b", "B ", "c", "Ab", "aB"]
    lists = [[random.choice(words) for _ in range(random.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lists)], "i int, items array<string>")
    got = {r.i: r.o for r in df.select("i", H._dedupe_ci(F.col("items")).alias("o")).collect()}
    for i, l in enumerate(lists):
        seen, exp = set(), []
        for x in l:
            if x.strip().lower() not in seen:
                seen.add(x.strip().lower())
                exp.append(x)
        assert got[i] == exp, (l, got[i])


def test_list_text_is_written_as_python_writes_it(spark):
    from docweave.operators.html import _py_list_repr
    items = ["plain", "it's", 'say "hi"', 'both \' and "', "back\\slash", "tab\there", "a\u00a0b", "z\u200bw", "\u2028", "é日本", ""]
    df = spark.createDataFrame([(items,), ([],), (["x'"],)], "items array<string>")
    got = [r[0] for r in df.select(_py_list_repr(F.col("items"))).collect()]
    assert got == [str(items), "[]", str(["x'"])]


def test_a_task_holds_few_parsed_pages(spark, monkeypatch):
    import pyarrow as pa

    held = []
    df = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.append(run) or self)
    H.parse_pages(df)
    n = 3 * H.PAGES_AT_ONCE + 1
    out = list(held[0](iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["<p>x</p>"] * n)], names=["page_id", "__html"])])))
    assert [b.num_rows for b in out] == [H.PAGES_AT_ONCE] * 3 + [1]
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
