"""Registered queries: graph tables (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import entities as EN
from docweave.operators import graph as G
from docweave.operators import html as H
from docweave.operators import topics as TP
from docweave.registry.html import _TP, table_pages
from docweave.registry.text import keywords_sql
from docweave.plans.parallel import spread
from docweave.session import scratch_dir, table, written


def _pairs(spark, sf):
    return H.table_pairs(H.parse_pages(table_pages(spark, sf)))


def _graph(spark, sf):
    return G.table_to_graph(_pairs(spark, sf), ["page_id", "table_no", "row_no"])


def q_table_to_graph(spark, sf):
    nodes, edges = _graph(spark, sf)
    a = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src").join(b, "dst")


def q_entity_chain_graph(spark, sf):
    # edge endpoints are nodes by construction and a node's label is a
    # function of its text, so no join back to the node table is needed
    _, edges = G.entity_chain_graph(spread(table(spark, sf, "documents")), "text")
    return edges.select("src", "dst", G.entity_label(F.col("src")).alias("src_label"),
                        G.entity_label(F.col("dst")).alias("dst_label"))


def q_multiword_names(spark, sf):
    return EN.multiword_names(spread(table(spark, sf, "documents"))).withColumn("ratio", F.round("ratio", 6))


def q_named_entity_graph(spark, sf):
    """Neighbouring entities of all documents, names of several words being
    one node."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    edges = EN.entity_edges(EN.tagged(docs, EN.multiword_names(docs)))
    return edges.select("src", "dst", G.entity_label(F.col("src")).alias("src_label"), G.entity_label(F.col("dst")).alias("dst_label"))


def q_graph_to_text(spark, sf):
    _, edges = _graph(spark, sf)
    return G.graph_to_text(edges)


def _topic_keywords(spark, sf):
    """Top words of the topics fitted to all documents."""
    words = TP.lda_topics(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", 5, 10, 42, 10)
    return words.select(F.concat(F.lit("Topic_"), F.col("topic").cast("string")).alias("topic"), F.col("term").alias("keyword"))


def _lang_keywords(spark, sf):
    """The distinct pairs, computed once: nodes and edges both read them."""
    docs = table(spark, sf, "documents")
    pairs = docs.select(F.col("lang").alias("topic"), tx.keyword_head(F.col("text"), 1).alias("keyword")).distinct()
    return written(pairs, "lang_keywords").filter(F.col("keyword") != "")


def q_topic_keyword_edges(spark, sf):
    _, edges = G.topic_keyword_edges(_topic_keywords(spark, sf))
    return edges


def q_match_pattern(spark, sf):
    nodes, edges = G.topic_keyword_edges(_topic_keywords(spark, sf))
    return G.match_pattern(nodes, edges, "Keyword", "RELATED_TO", "Topic").select("line")


def q_format_triples(spark, sf):
    nodes, edges = G.topic_keyword_edges(_topic_keywords(spark, sf))
    m = G.match_pattern(nodes, edges, "Keyword", "RELATED_TO", "Topic")
    return G.format_triples(m, "dst").withColumnRenamed("dst", "topic")


def q_lang_keyword_edges(spark, sf):
    _, edges = G.topic_keyword_edges(_lang_keywords(spark, sf))
    return edges


def q_lang_match_pattern(spark, sf):
    nodes, edges = G.topic_keyword_edges(_lang_keywords(spark, sf))
    return G.match_pattern(nodes, edges, "Keyword", "RELATED_TO", "Topic").select("line")


def q_lang_format_triples(spark, sf):
    nodes, edges = G.topic_keyword_edges(_lang_keywords(spark, sf))
    m = G.match_pattern(nodes, edges, "Keyword", "RELATED_TO", "Topic")
    return G.format_triples(m, "dst").withColumnRenamed("dst", "topic")


def graph_scripts(spark, sf):
    """One graph script per region: create the region and its nations, link
    each nation to the region, and link a never-created Continent node; one
    empty statement. Nations per region are a bounded group."""
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation")
    nat = n.select(F.col("n_regionkey").alias("r_regionkey"), F.struct(
        F.col("n_nationkey").alias("k"),
        F.format_string("CREATE (:Nation {name: '%s'});\nMATCH (r:Region {name: '%s'}) "
                        "MATCH (n:Nation {name: '%s'}) CREATE (n)-[:IN]->(r)",
                        "n_name", F.lit("{R}"), "n_name").alias("s")).alias("x"))
    per = nat.groupBy("r_regionkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["s"]), ";\n")
    script = F.concat(
        F.format_string("CREATE (:Region {name: '%s'});\n", "r_name"),
        F.replace(body, F.lit("{R}"), F.col("r_name")), F.lit(";\n;\n"),
        F.format_string("MATCH (c:Continent {name: '%s'}) MATCH (r:Region {name: '%s'}) "
                        "CREATE (c)-[:HAS]->(r);", "r_name", "r_name"))
    return r.join(per, "r_regionkey", "left").select("r_regionkey", script.alias("script"))


def q_scan_graph_script(spark, sf):
    return G.split_statements(graph_scripts(spark, sf), "script", "r_regionkey")


def q_graph_script_to_tables(spark, sf):
    st = G.split_statements(graph_scripts(spark, sf), "script", "r_regionkey")
    nodes, edges, rejected = G.script_to_tables(st, "r_regionkey")
    return edges


def vis_pages(spark, sf):
    """One vis.js page per region: nodes (region + its nations) and edges."""
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation")
    per = n.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    j = r.join(per, r["r_regionkey"] == per["n_regionkey"], "left")
    nodes = F.concat(F.array(F.struct(F.col("r_name").alias("id"), F.lit("Region").alias("title"))),
                     F.transform("ns", lambda x: F.struct(x["n_name"].alias("id"), F.lit("Nation").alias("title"))))
    edges = F.transform("ns", lambda x: F.struct(x["n_name"].alias("from"), F.col("r_name").alias("to")))
    html = F.concat(F.lit("<html><body><div id='g'></div><script>var nodes = new vis.DataSet("),
                    F.to_json(nodes), F.lit(");\nvar edges = new vis.DataSet("), F.to_json(edges),
                    F.lit(");</script></body></html>"))
    return j.select("r_regionkey", html.alias("html"))


def q_scan_vis_graph(spark, sf):
    nodes, edges = G.vis_graph(vis_pages(spark, sf), "html", "r_regionkey")
    return edges.join(nodes.select("r_regionkey", F.col("id").alias("src"), F.col("label").alias("src_label")),
                      ["r_regionkey", "src"], "left")


def q_sink_graph(spark, sf):
    """Upsert the table graph's edges twice into a written table; the second
    run adds nothing."""
    _, edges = _graph(spark, sf)
    path = scratch_dir(spark, "graph_edges")
    keys = ["src", "dst"]
    edges.limit(0).write.mode("overwrite").parquet(path)
    for _ in range(2):
        existing = spark.read.parquet(path)
        G.upsert(existing, edges, keys).write.mode("append").parquet(path)
    return spark.read.parquet(path)


QUERIES = {
    "table_to_graph": q_table_to_graph,
    "entity_chain_graph": q_entity_chain_graph,
    "multiword_names": q_multiword_names,
    "named_entity_graph": q_named_entity_graph,
    "graph_to_text": q_graph_to_text,
    "format_triples": q_format_triples,
    "topic_keyword_edges": q_topic_keyword_edges,
    "match_pattern": q_match_pattern,
    "lang_format_triples": q_lang_format_triples,
    "lang_keyword_edges": q_lang_keyword_edges,
    "lang_match_pattern": q_lang_match_pattern,
    "graph_script_to_tables": q_graph_script_to_tables,
    "scan_graph_script": q_scan_graph_script,
    "scan_vis_graph": q_scan_vis_graph,
    "sink_graph": q_sink_graph,
}

_WRITES = f"""{_TP},
  pairs AS (SELECT page_id, 1 AS table_no, 1 AS row_no, 'Back' AS entity, 'Forward' AS lim FROM tp WHERE has_nav
    UNION ALL SELECT page_id, CASE WHEN has_nav THEN 2 ELSE 1 END, r.row_no, r.e, r.l
    FROM tp, LATERAL (SELECT * FROM (VALUES (1, 'Types', 'Limits'), (2, p_type, size_s), (3, p_brand, price_s)) v(row_no, e, l)) r),
  writes AS (SELECT entity AS id, 'Type' AS label, page_id, table_no, row_no, 0 AS pos FROM pairs
             UNION ALL SELECT lim, 'Limit', page_id, table_no, row_no, 1 FROM pairs),
  nodes AS (SELECT id, arg_max(label, (page_id, table_no, row_no, pos)) AS label FROM writes GROUP BY id),
  edges AS (SELECT DISTINCT least(entity, lim) AS src, greatest(entity, lim) AS dst FROM pairs)"""

_ENT = (f"list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: regexp_matches(t, '^\\p{{Lu}}') AND length(t) >= 2)")


_TK = f"""tk AS (SELECT DISTINCT lang AS topic, array_to_string({keywords_sql('text')}[1:1], ' ') AS keyword
                FROM documents WHERE array_to_string({keywords_sql('text')}[1:1], ' ') <> '')"""

ORACLE = {
    "table_to_graph": f"""WITH {_WRITES}
SELECT e.src, e.dst, a.label AS src_label, b.label AS dst_label
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst""",
    "graph_to_text": f"WITH {_WRITES} SELECT src, dst, src || ': ' || dst AS text FROM edges",
    "multiword_names": rf"""WITH p AS (SELECT string_split(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?: [\p{{L}}\p{{N}}]+)*')), ' ') AS w FROM documents),
  g AS (SELECT k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g FROM (
          SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {EN.LONGEST + 1}) t(k))
        WHERE len(list_filter(w[i:i + k - 1], lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))) = 0),
  c AS (SELECT k, g, count(*) AS n FROM g GROUP BY k, g),
  tot AS (SELECT sum(n) AS total FROM c WHERE k = 1),
  pr AS (SELECT c.g AS pair, c.n * tot.total / (a.n * b.n) AS ratio FROM c JOIN c a ON a.k = 1 AND a.g = split_part(c.g, ' ', 1)
         JOIN c b ON b.k = 1 AND b.g = split_part(c.g, ' ', 2), tot WHERE c.k = 2),
  i AS (SELECT g, k, n, unnest(range(1, k)) AS j FROM c WHERE k > 1 AND n >= {EN.LEAST}),
  h AS (SELECT i.g, i.k, i.n, min(pr.ratio) AS ratio, count(*) AS held FROM i
        JOIN pr ON pr.pair = split_part(i.g, ' ', i.j::INTEGER) || ' ' || split_part(i.g, ' ', (i.j + 1)::INTEGER)
        WHERE pr.ratio >= {EN.RATIO} GROUP BY i.g, i.k, i.n)
SELECT g AS name, CAST(k AS INTEGER) AS n_words, n, round(ratio, 6) AS ratio FROM h WHERE held = k - 1""",
    "entity_chain_graph": f"""WITH d AS (SELECT {_ENT} AS e FROM documents),
  p AS (SELECT e[i] AS a, e[i + 1] AS b FROM d, range(1, len(e)) t(i) WHERE len(e) >= 2),
  edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM p),
  nodes AS (SELECT DISTINCT unnest(e) AS id FROM d WHERE len(e) >= 2),
  nl AS (SELECT id, CASE WHEN id = upper(id) THEN 'ACRONYM' ELSE 'NAME' END AS label FROM nodes)
SELECT e.src, e.dst, a.label AS src_label, b.label AS dst_label
FROM edges e JOIN nl a ON a.id = e.src JOIN nl b ON b.id = e.dst""",
    "lang_keyword_edges": f"""WITH {_TK}
SELECT DISTINCT 'Keyword' AS src_label, keyword AS src, 'RELATED_TO' AS rel, 'Topic' AS dst_label, topic AS dst FROM tk""",
    "lang_match_pattern": f"""WITH {_TK}
SELECT DISTINCT keyword || ' -[RELATED_TO]-> ' || topic AS line FROM tk""",
    "lang_format_triples": f"""WITH {_TK}
SELECT topic, string_agg(keyword || ' -[RELATED_TO]-> ' || topic, chr(10) ORDER BY keyword || ' -[RELATED_TO]-> ' || topic) AS text
FROM tk GROUP BY topic""",
    "graph_script_to_tables": """SELECT n.n_regionkey AS r_regionkey, 'Nation' AS src_label, n.n_name AS src, 'IN' AS rel,
       'Region' AS dst_label, r.r_name AS dst
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "scan_graph_script": """WITH n AS (SELECT n_regionkey, n_name,
           CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS k FROM nation),
  cnt AS (SELECT r.r_regionkey, r.r_name, CAST(count(n.n_name) AS INTEGER) AS c FROM region r
          LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name)
SELECT r_regionkey, 1 AS stmt_no, 'CREATE (:Region {name: ''' || r_name || '''})' AS stmt FROM cnt
UNION ALL SELECT n.n_regionkey, 2 * n.k, 'CREATE (:Nation {name: ''' || n.n_name || '''})' FROM n
UNION ALL SELECT n.n_regionkey, 2 * n.k + 1, 'MATCH (r:Region {name: ''' || c.r_name || '''}) MATCH (n:Nation {name: '''
       || n.n_name || '''}) CREATE (n)-[:IN]->(r)' FROM n JOIN cnt c ON c.r_regionkey = n.n_regionkey
UNION ALL SELECT r_regionkey, 2 * c + 2, 'MATCH (c:Continent {name: ''' || r_name || '''}) MATCH (r:Region {name: '''
       || r_name || '''}) CREATE (c)-[:HAS]->(r)' FROM cnt""",
    "scan_vis_graph": """SELECT n.n_regionkey AS r_regionkey, least(n.n_name, r.r_name) AS src,
       greatest(n.n_name, r.r_name) AS dst,
       CASE WHEN n.n_name < r.r_name THEN 'Nation' ELSE 'Region' END AS src_label
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "sink_graph": f"WITH {_WRITES} SELECT src, dst FROM edges",
}
