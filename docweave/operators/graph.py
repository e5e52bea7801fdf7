"""Graph tables: nodes/edges from tables, entity chains, pattern matching,
graph-script loading and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import ustrip

# ---------------------------------------------------------------------------
# undirected graphs: nodes(id, label), edges(src, dst) with src <= dst


def table_to_graph(pairs: DataFrame, order_cols: list[str]):
    """Two-column rows (entity, limit) -> nodes labelled Type / Limit and
    undirected edges. A string seen in both roles keeps the label written
    last (row order, entity before limit)."""
    o = F.struct(*[F.col(c) for c in order_cols])
    writes = (pairs.select(F.col("entity").alias("id"), F.lit("Type").alias("label"),
                           F.struct(o.alias("o"), F.lit(0).alias("pos")).alias("seq"))
              .unionByName(pairs.select(F.col("limit").alias("id"), F.lit("Limit").alias("label"),
                                        F.struct(o.alias("o"), F.lit(1).alias("pos")).alias("seq"))))
    nodes = writes.groupBy("id").agg(F.max_by("label", "seq").alias("label"))
    edges = pairs.select(F.least("entity", "limit").alias("src"),
                         F.greatest("entity", "limit").alias("dst")).distinct()
    return nodes, edges


def entity_tokens(c: Column) -> Column:
    """Entities (no NER model offline): letter/digit runs of 2+ chars that
    start with a capital letter, in text order."""
    # one pass: a run may only start where no letter/digit precedes it
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]+"), 0)


def entity_chain_graph(docs: DataFrame, text_col: str):
    """Consecutive entities of each text linked, an entity followed by itself
    to itself (re-aimed extraction: no NER model offline). Node label: ACRONYM (all capitals) or NAME; texts with
    fewer than two entities add nothing. Built inside each row, then
    de-duplicated."""
    ents = entity_tokens(F.col(text_col))
    d = docs.select(ents.alias("e"))
    pairs = d.select(F.explode(F.when(F.size("e") >= 2, F.arrays_zip(
        F.slice("e", 1, F.size("e") - 1).alias("a"), F.slice("e", 2, F.size("e")).alias("b")))
        .otherwise(F.array().cast("array<struct<a:string,b:string>>"))).alias("p"))
    edges = (pairs.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
             .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    nodes = (d.filter(F.size("e") >= 2).select(F.explode("e").alias("id")).distinct()
             .withColumn("label", entity_label(F.col("id"))))
    return nodes, edges


def entity_label(e: Column) -> Column:
    """ACRONYM (all capitals) or NAME: a function of the entity alone."""
    return F.when(e == F.upper(e), F.lit("ACRONYM")).otherwise(F.lit("NAME"))


def graph_to_text(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.concat_ws(": ", "src", "dst").alias("text"))


def format_triple(src: Column, rel: Column, dst: Column) -> Column:
    return F.format_string("%s -[%s]-> %s", src, rel, dst)


def format_triples(triples: DataFrame, group_col: str) -> DataFrame:
    """Triples as ``from -[rel]-> to`` lines, newline-joined per group in
    line order (a group holds one node's bounded set of relations)."""
    lines = triples.select(group_col, format_triple(F.col("src"), F.col("rel"), F.col("dst")).alias("l"))
    return lines.groupBy(group_col).agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("text"))


# ---------------------------------------------------------------------------
# property graphs: nodes(label, key, props), edges(src_label, src, rel, dst_label, dst)


def topic_keyword_edges(pairs: DataFrame):
    """``(topic, keyword)`` rows -> MERGEd ``Topic`` and ``Keyword`` nodes and
    ``(keyword)-[:RELATED_TO]->(topic)`` edges (duplicates collapse)."""
    nodes = (pairs.select(F.lit("Topic").alias("label"), F.col("topic").alias("key"))
             .unionByName(pairs.select(F.lit("Keyword").alias("label"), F.col("keyword").alias("key")))
             .distinct())
    edges = pairs.select(F.lit("Keyword").alias("src_label"), F.col("keyword").alias("src"),
                         F.lit("RELATED_TO").alias("rel"), F.lit("Topic").alias("dst_label"),
                         F.col("topic").alias("dst")).distinct()
    return nodes, edges


def match_pattern(nodes: DataFrame, edges: DataFrame, src_label: str, rel: str, dst_label: str) -> DataFrame:
    """One-hop ``(a:src_label)-[:rel]->(b:dst_label)`` -> formatted lines."""
    a = nodes.filter(F.col("label") == src_label).select(F.col("key").alias("src"))
    b = nodes.filter(F.col("label") == dst_label).select(F.col("key").alias("dst"))
    e = edges.filter((F.col("rel") == rel) & (F.col("src_label") == src_label)
                     & (F.col("dst_label") == dst_label))
    return (e.join(a, "src", "left_semi").join(b, "dst", "left_semi")
            .select("src", "rel", "dst", format_triple(F.col("src"), F.col("rel"), F.col("dst")).alias("line")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent MERGE: new rows not already present (by ``keys``)."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


# ---------------------------------------------------------------------------
# graph scripts (subset: nodes ``(var:Label {name: '...'})``)

_NODE = r"\(\s*(\w*)\s*:\s*(\w+)\s*\{[^}]*?name\s*:\s*['\"]([^'\"]*)['\"][^}]*\}\s*\)"
_EDGE = r"\(\s*(\w+)\s*\)\s*-\s*\[\s*:\s*(\w+)[^\]]*\]\s*->\s*\(\s*(\w+)\s*\)"


def split_statements(scripts: DataFrame, script_col: str, id_col: str) -> DataFrame:
    """Script -> ``(id, stmt_no, stmt)``: split on ``;``, trimmed, empties
    dropped, numbered from 1 in order (within the row)."""
    parts = F.filter(F.transform(F.split(F.col(script_col), ";"), ustrip), lambda s: s != "")
    return scripts.select(id_col, F.posexplode(parts).alias("i", "stmt")).select(
        id_col, (F.col("i") + 1).alias("stmt_no"), "stmt")


def script_to_tables(stmts: DataFrame, id_col: str):
    """Statements -> (nodes, edges, rejected), for the subset where nodes are
    ``(var:Label {name: 'x'})`` and edges ``(a)-[:REL]->(b)`` between bound
    variables.

    * in a statement starting with CREATE or MERGE, node patterns create
      nodes (MERGE and repeats collapse);
    * in a statement starting with MATCH, node patterns bind variables only
      to nodes created by an earlier statement; an absent node binds
      nothing, so its edges are not made;
    * a statement with no recognised pattern is rejected, and, as loading
      stops at the first failing statement, later statements are ignored."""
    s = stmts.select(id_col, "stmt_no", "stmt",
                     F.upper(F.regexp_extract("stmt", r"^\s*(\w+)", 1)).alias("verb"))
    pats = (s.select(id_col, "stmt_no", "verb",
                     F.explode(F.regexp_extract_all("stmt", F.lit(_NODE), 0)).alias("p"))
            .select(id_col, "stmt_no", "verb",
                    F.regexp_extract("p", _NODE, 1).alias("var"),
                    F.regexp_extract("p", _NODE, 2).alias("label"),
                    F.regexp_extract("p", _NODE, 3).alias("name")))
    ed = (s.select(id_col, "stmt_no", F.explode(F.regexp_extract_all("stmt", F.lit(_EDGE), 0)).alias("e"))
          .select(id_col, "stmt_no", F.regexp_extract("e", _EDGE, 1).alias("a"),
                  F.regexp_extract("e", _EDGE, 2).alias("rel"), F.regexp_extract("e", _EDGE, 3).alias("b")))
    has_pattern = pats.select(id_col, "stmt_no").unionByName(ed.select(id_col, "stmt_no")).distinct()
    ok = s.filter(F.col("verb").isin("CREATE", "MERGE", "MATCH")).join(has_pattern, [id_col, "stmt_no"], "left_semi")
    rejected = s.join(ok, [id_col, "stmt_no"], "left_anti").select(id_col, "stmt_no", "stmt")
    first_bad = rejected.groupBy(id_col).agg(F.min("stmt_no").alias("__bad"))

    def alive(df):
        return (df.join(first_bad, id_col, "left")
                .filter(F.col("__bad").isNull() | (F.col("stmt_no") < F.col("__bad"))).drop("__bad"))

    pats = alive(pats)
    created = pats.filter(F.col("verb") != "MATCH")
    nodes = created.groupBy(id_col, "label", "name").agg(F.min("stmt_no").alias("__first"))
    matched = (pats.filter(F.col("verb") == "MATCH").join(nodes, [id_col, "label", "name"])
               .filter(F.col("__first") < F.col("stmt_no")))
    cols = [id_col, "stmt_no", "var", "label", "name"]
    binds = created.select(*cols).unionByName(matched.select(*cols)).filter(F.col("var") != "")
    A = binds.select(id_col, "stmt_no", F.col("var").alias("a"), F.col("label").alias("src_label"),
                     F.col("name").alias("src"))
    B = binds.select(id_col, "stmt_no", F.col("var").alias("b"), F.col("label").alias("dst_label"),
                     F.col("name").alias("dst"))
    edges = (alive(ed).join(A, [id_col, "stmt_no", "a"]).join(B, [id_col, "stmt_no", "b"])
             .select(id_col, "src_label", "src", "rel", "dst_label", "dst").distinct())
    return nodes.select(id_col, "label", "name"), edges, rejected


def vis_graph(pages: DataFrame, html_col: str, id_col: str):
    """``nodes = new vis.DataSet([...])`` / ``edges = ...`` arrays pulled from
    a page by regex and parsed as JSON -> (nodes(id, label), edges(src, dst))."""
    n_json = F.regexp_extract(F.col(html_col), r"(?s)nodes\s*=\s*new vis\.DataSet\((\[.*?\])\);", 1)
    e_json = F.regexp_extract(F.col(html_col), r"(?s)edges\s*=\s*new vis\.DataSet\((\[.*?\])\);", 1)
    p = pages.select(id_col,
                     F.from_json(n_json, "array<struct<id:string,title:string>>").alias("n"),
                     F.from_json(e_json, "array<struct<`from`:string,`to`:string>>").alias("e"))
    nodes = p.select(id_col, F.explode_outer("n").alias("x")).filter(F.col("x").isNotNull()).select(
        id_col, F.col("x.id").alias("id"), F.coalesce(F.col("x.title"), F.lit("Type")).alias("label"))
    edges = p.select(id_col, F.explode_outer("e").alias("x")).filter(F.col("x").isNotNull()).select(
        id_col, F.least(F.col("x.from"), F.col("x.to")).alias("src"),
        F.greatest(F.col("x.from"), F.col("x.to")).alias("dst")).distinct()
    return nodes, edges
