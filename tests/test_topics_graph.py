"""Topics and graph operators on hand-made inputs."""

from pyspark.sql import functions as F

from docweave.operators import graph as G
from docweave.operators import topics as TP


def test_topic_tree_empty_gives_no_data(spark):
    empty = spark.createDataFrame([], "topic string, sub string")
    assert [tuple(r) for r in TP.topic_tree(empty).collect()] == [("No Data", [])]
    items = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("b", "z")], "topic string, sub string")
    assert sorted(tuple(r) for r in TP.topic_tree(items).collect()) == [("a", ["x", "y"]), ("b", ["z"])]


def test_connected_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 6)], "src long, dst long")
    comps = {r.id: r.comp for r in TP.connected_components(nodes, edges, checkpoint_every=1).collect()}
    assert comps == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}


def test_table_graph_last_label_wins(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "A", "B"), (1, 1, 2, "B", "C")],
                                  "page_id long, table_no int, row_no int, entity string, limit string")
    nodes, edges = G.table_to_graph(pairs, ["page_id", "table_no", "row_no"])
    assert {r.id: r.label for r in nodes.collect()} == {"A": "Type", "B": "Type", "C": "Limit"}
    assert sorted(tuple(r) for r in edges.collect()) == [("A", "B"), ("B", "C")]


def test_graph_script_subset(spark):
    script = """CREATE (:Concept {name: 'A', type: 'Document'});
CREATE (:Concept {name: 'B'});;
MATCH (a:Concept {name:'A'}) MATCH (b:Concept {name:'B'}) CREATE (a)-[:LINKS {description: 'x'}]->(b);
MATCH (a:Concept {name:'A'}) MATCH (z:Ghost {name:'Z'}) CREATE (a)-[:NOPE]->(z);
this is not a statement;
CREATE (:Concept {name: 'C'})"""
    df = spark.createDataFrame([(1, script)], "id long, script string")
    st = G.split_statements(df, "script", "id")
    assert [r.stmt_no for r in st.orderBy("stmt_no").collect()] == [1, 2, 3, 4, 5, 6]
    nodes, edges, rejected = G.script_to_tables(st, "id")
    assert sorted(r.name for r in nodes.collect()) == ["A", "B"]  # loading stopped before 'C'
    assert [(r.src, r.rel, r.dst) for r in edges.collect()] == [("A", "LINKS", "B")]
    assert [r.stmt_no for r in rejected.collect()] == [5]


def test_vis_graph(spark):
    html = ('<script>var nodes = new vis.DataSet([{"id": "x", "title": "T"}, {"id": "y"}]);\n'
            'var edges = new vis.DataSet([{"from": "y", "to": "x"}]);</script>')
    df = spark.createDataFrame([(1, html)], "pid long, html string")
    nodes, edges = G.vis_graph(df, "html", "pid")
    assert sorted((r.id, r.label) for r in nodes.collect()) == [("x", "T"), ("y", "Type")]
    assert [(r.src, r.dst) for r in edges.collect()] == [("x", "y")]


def test_connected_components_long_chain_and_random(spark):
    import random
    n = 300
    chain = [(i, i + 1) for i in range(0, n - 1)]  # diameter n-1
    random.seed(2)
    extra = [(random.randrange(n, 2 * n), random.randrange(n, 2 * n)) for _ in range(250)]
    nodes = spark.createDataFrame([(i,) for i in range(2 * n)], "id long")
    edges = spark.createDataFrame(chain + extra, "src long, dst long")
    got = {r.id: r.comp for r in TP.connected_components(nodes, edges).collect()}
    parent = list(range(2 * n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in chain + extra:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    comp_min = {}
    for i in range(2 * n):
        comp_min.setdefault(find(i), []).append(i)
    exp = {i: min(comp_min[find(i)]) for i in range(2 * n)}
    assert got == exp


def test_knowledge_tree(spark):
    empty = spark.createDataFrame([], "q string, content string")
    assert [tuple(r) for r in TP.knowledge_tree(empty, "q", "content").collect()] == [("No Data", [])]
    qs = spark.createDataFrame([("1", "how to export a table"), ("2", "export table to csv"),
                                ("3", "change plot colour"), ("4", "plot colour settings")],
                               "q string, content string")
    tree = {r.topic: r.children for r in TP.knowledge_tree(qs, "q", "content", k_max=2, restarts=2).collect()}
    assert sorted(c for cs in tree.values() for c in cs) == ["change", "export", "export", "plot"] or \
        set(c for cs in tree.values() for c in cs) == {"change", "export", "plot"}


def test_lang_keywords_are_computed_once(spark, monkeypatch, tmp_path):
    from docweave.registry import graph as RG

    late = "the " * 150 + "late word"  # beyond the beginning that is looked at first
    rows = [(1, "en", "Red roses"), (2, "en", "the red one"), (3, "de", late), (4, "de", ""), (5, None, "x"), (6, "fr", None), (7, "it", "a" * 900)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept, old = [], RG.written
    monkeypatch.setattr(RG, "written", lambda df, name: kept.append(df) or old(df, name))
    got = sorted(r["line"] for r in RG.q_lang_match_pattern(spark, str(tmp_path)).collect())
    assert got == sorted(["red -[RELATED_TO]-> en", "late -[RELATED_TO]-> de", "a" * 900 + " -[RELATED_TO]-> it"])
    assert len(kept) == 1
