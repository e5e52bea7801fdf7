"""Registered queries: HTML extraction (§2.3) and path keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import html as H
from docweave.operators import pages as P
from docweave.registry.sqlfrag import WS
from docweave.session import table


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


def _parsed(spark, sf, body_only=False):
    return H.parse_pages(_pages(spark, sf), body_only=body_only)


def table_pages(spark, sf):
    """One generated help page per part row: a two-column limits table
    (header, two value rows, one row with a blank cell) and, for parts of
    size 25 or more, a Back/Forward navigation table first."""
    p = table(spark, sf, "part")
    nav = F.when(F.col("p_size") >= 25,
                 F.lit("<table><tr><td>Back</td><td>Forward</td></tr></table>")).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1>"), nav,
        F.lit("<table><tr><th>Types</th><th>Limits</th></tr><tr><td>"), F.col("p_type"),
        F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td>"),
        F.col("p_brand"), F.lit("</td><td> "), F.col("p_retailprice").cast("string"),
        F.lit(" </td></tr><tr><td>Container</td><td></td></tr></table></body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"),
                    F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"), F.lit(".htm")).alias("url"),
                    html.alias("html"))


def _tparsed(spark, sf):
    return H.parse_pages(table_pages(spark, sf))


def q_html_body_slice(spark, sf):
    return _pages(spark, sf).select("page_id", tx.body_slice(F.col("html")).alias("body"),
                                    tx.body_missing(F.col("html")).alias("body_missing"))


def q_html_visible_text(spark, sf):
    return _parsed(spark, sf).select("page_id", H.visible_text(F.col("nodes"), "\n", True).alias("text"))


def q_html_nav_filter(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(~tx.nav_match(F.col("line"), full=True))


def q_html_paragraphs(spark, sf):
    return _parsed(spark, sf, True).select("page_id", H.paragraphs(F.col("paras")).alias("text"))


def q_html_block_text(spark, sf):
    return _parsed(spark, sf).select("page_id", H.block_text(F.col("nodes"), F.col("paras")).alias("text"))


def q_html_list_items(spark, sf):
    return _parsed(spark, sf, True).select(
        "page_id", F.posexplode(H.list_items(F.col("lists"))).alias("list_no", "items")).select(
        "page_id", "list_no", F.array_join("items", "␟").alias("items"))


def q_html_list_bullets(spark, sf):
    return _parsed(spark, sf).select(
        "page_id", H.list_bullets(F.col("lists"), F.col("stray_items")).alias("bullets"))


def q_html_table_rows(spark, sf):
    return H.table_rows(_tparsed(spark, sf)).select(
        "page_id", "table_no", "row_no", F.array_join("cells", " | ").alias("cells"))


def q_html_table_nav_filter(spark, sf):
    return _tparsed(spark, sf).select(
        "page_id", F.size("tables").alias("n_tables"),
        F.size(H.content_tables(F.col("tables"))).alias("n_content_tables"))


def q_html_table_text(spark, sf):
    return _tparsed(spark, sf).select("page_id", H.table_text(F.col("tables")).alias("text"))


def q_html_table_grid(spark, sf):
    return _tparsed(spark, sf).select("page_id", H.tables_as_grids(F.col("tables")).alias("grid"))


def q_html_table_pairs(spark, sf):
    return H.table_pairs(_tparsed(spark, sf))


def q_html_links(spark, sf):
    return _parsed(spark, sf).select("page_id", F.posexplode("links").alias("link_no", "href"))


def q_page_document(spark, sf):
    parsed = _parsed(spark, sf, True)
    return H.page_document(parsed, ("text", "table", "list"),
                           page_name=P.base_name(F.col("url"))).select(
        "page_id", "page_name", "page_content", F.size("links").alias("n_links"))


def q_page_document_full(spark, sf):
    return H.page_document_full(_parsed(spark, sf)).select("page_id", "source", "content")


def q_options_match(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", P.options_match(P.event_options()).alias("all_options"))


def q_path_keys(spark, sf):
    return P.path_keys(_pages(spark, sf).select("page_id", "url"), "url")


def q_suffix_lookup(spark, sf):
    req = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name")).distinct()
    return P.suffix_lookup(_pages(spark, sf).select("page_id", "url"), req)


def q_decode_quarantine(spark, sf):
    raw = _pages(spark, sf).select("page_id", F.col("html").cast("binary").alias("content"))
    return P.decode_quarantine(raw).select("page_id", "status", "n_bytes")


QUERIES = {
    "html_body_slice": q_html_body_slice,
    "html_visible_text": q_html_visible_text,
    "html_nav_filter": q_html_nav_filter,
    "html_paragraphs": q_html_paragraphs,
    "html_block_text": q_html_block_text,
    "html_list_items": q_html_list_items,
    "html_list_bullets": q_html_list_bullets,
    "html_table_rows": q_html_table_rows,
    "html_table_nav_filter": q_html_table_nav_filter,
    "html_table_text": q_html_table_text,
    "html_table_grid": q_html_table_grid,
    "html_table_pairs": q_html_table_pairs,
    "html_links": q_html_links,
    "page_document": q_page_document,
    "page_document_full": q_page_document_full,
    "options_match": q_options_match,
    "path_keys": q_path_keys,
    "suffix_lookup": q_suffix_lookup,
    "decode_quarantine": q_decode_quarantine,
}

_NAV = "|".join(tx.NAV_PATTERNS_FULL).replace(r"\s", WS).replace("'", "''")
_NAV1 = "|".join(tx.NAV_PATTERNS).replace(r"\s", WS).replace("'", "''")
# tags whose start (or end) closes an open paragraph in the fixture's markup
_BLOCK = ("address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|"
          "footer|form|h1|h2|h3|h4|h5|h6|header|hgroup|hr|li|main|menu|nav|ol|pre|section|summary|table|ul")


def _decode(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), "
            f"'&amp;', '&')")

_TP = """tp AS (SELECT p_partkey AS page_id, p_size >= 25 AS has_nav, p_type, CAST(p_size AS VARCHAR) AS size_s,
               p_brand, CAST(p_retailprice AS VARCHAR) AS price_s FROM part)"""

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


_PARAS = f"""b AS (
    SELECT page_id, CASE WHEN instr(html, '<body>') > 0 THEN instr(html, '<body>') + 6 ELSE 1 END AS s,
           CASE WHEN instr(html, '</body>') > 0 THEN instr(html, '</body>') ELSE length(html) + 1 END AS e, html
    FROM pages),
  body AS (SELECT page_id, CASE WHEN e >= s THEN substr(html, s, e - s) ELSE '' END AS body FROM b),
  seg AS (SELECT page_id, i, x[i] AS sg FROM (
            SELECT page_id, string_split(regexp_replace(body, '(<p[\\s>]|</?(?:{_BLOCK})[\\s>/])', chr(1) || '\\1', 'g'),
                                         chr(1)) AS x FROM body), range(1, len(x) + 1) t(i)),
  par AS (SELECT page_id, i, split_part(substr(sg, instr(sg, '>') + 1), '</p>', 1) AS c
          FROM seg WHERE regexp_matches(sg, '^<p[\\s>]')),
  txt AS (SELECT page_id, i, {_decode("regexp_replace(c, '<[^>]*>', '', 'g')")} AS raw,
                 array_to_string(list_transform(regexp_split_to_array(c, '<[^>]*>'),
                   lambda y: regexp_replace({_decode('y')}, '^{WS}+|{WS}+$', '', 'g')), '') AS stripped
          FROM par),
  keep AS (SELECT * FROM txt WHERE NOT regexp_matches(raw, '{_NAV1}', 'i') AND length(stripped) > 20)"""


def _grid_sql() -> str:
    w1 = "greatest(5, length(p_type), length(p_brand), 9)"
    w2 = "greatest(6, length(size_s), length(price_s), 0)"
    rule = f"'+' || repeat('-', {w1} + 2) || '+' || repeat('-', {w2} + 2) || '+'"
    rule_eq = f"'+' || repeat('=', {w1} + 2) || '+' || repeat('=', {w2} + 2) || '+'"

    def line(a, b):
        return f"'| ' || rpad({a}, CAST({w1} AS INTEGER), ' ') || ' | ' || rpad({b}, CAST({w2} AS INTEGER), ' ') || ' |'"
    nl = "chr(10)"
    return (f"{rule} || {nl} || {line(chr(39) + 'Types' + chr(39), chr(39) + 'Limits' + chr(39))} || {nl} || {rule_eq}"
            f" || {nl} || {line('p_type', 'size_s')} || {nl} || {rule}"
            f" || {nl} || {line('p_brand', 'price_s')} || {nl} || {rule}"
            f" || {nl} || {line(chr(39) + 'Container' + chr(39), chr(39) + chr(39))} || {nl} || {rule}")


ORACLE = {
    "html_body_slice": """SELECT page_id,
  CASE WHEN (CASE WHEN instr(html, '</body>') > 0 THEN instr(html, '</body>') ELSE length(html) + 1 END)
            >= (CASE WHEN instr(html, '<body>') > 0 THEN instr(html, '<body>') + 6 ELSE 1 END)
       THEN substr(html, CASE WHEN instr(html, '<body>') > 0 THEN instr(html, '<body>') + 6 ELSE 1 END,
                   (CASE WHEN instr(html, '</body>') > 0 THEN instr(html, '</body>') ELSE length(html) + 1 END)
                   - (CASE WHEN instr(html, '<body>') > 0 THEN instr(html, '<body>') + 6 ELSE 1 END))
       ELSE '' END AS body,
  instr(html, '<body>') = 0 OR instr(html, '</body>') = 0 AS body_missing
FROM pages""",
    "html_nav_filter": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) t(i)
WHERE NOT coalesce(regexp_matches(l[i], '{_NAV}', 'i'), false)""",
    "html_table_rows": f"""WITH {_TP}
SELECT page_id, 1 AS table_no, 1 AS row_no, 'Back | Forward' AS cells FROM tp WHERE has_nav
UNION ALL SELECT page_id, CASE WHEN has_nav THEN 2 ELSE 1 END, r.row_no, r.cells
FROM tp, LATERAL (SELECT * FROM (VALUES (1, 'Types | Limits'), (2, p_type || ' | ' || size_s),
                                        (3, p_brand || ' | ' || price_s), (4, 'Container | ')) v(row_no, cells)) r""",
    "html_table_nav_filter": f"""WITH {_TP}
SELECT page_id, CASE WHEN has_nav THEN 2 ELSE 1 END AS n_tables, 1 AS n_content_tables FROM tp""",
    "html_table_text": f"""WITH {_TP}
SELECT page_id, 'Types | Limits' || chr(10) || p_type || ' | ' || size_s || chr(10) || p_brand || ' | ' || price_s
       || chr(10) || 'Container |' AS text FROM tp""",
    "html_table_grid": f"WITH {_TP} SELECT page_id, {_grid_sql()} AS grid FROM tp",
    "html_table_pairs": f"""WITH {_TP}
SELECT page_id, 1 AS table_no, 1 AS row_no, 'Back' AS entity, 'Forward' AS "limit" FROM tp WHERE has_nav
UNION ALL SELECT page_id, CASE WHEN has_nav THEN 2 ELSE 1 END, r.row_no, r.e, r.l
FROM tp, LATERAL (SELECT * FROM (VALUES (1, 'Types', 'Limits'), (2, p_type, size_s),
                                        (3, p_brand, price_s)) v(row_no, e, l)) r""",
    "html_links": """SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, l[i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages),
     range(1, len(l) + 1) t(i)""",
    "options_match": f"""SELECT event_id,
  list_sort(list_distinct({P.EVENT_OPTIONS_SQL})) = ['list', 'table', 'text'] AS all_options FROM events""",
    "path_keys": f"""WITH p AS (SELECT page_id, url, {_PATH} AS path FROM pages),
  s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, parts[-1] AS base_name,
       regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem,
       CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE '' END || '_' || regexp_replace(parts[-1], '\\.[^.]*$', '') AS parent_stem
FROM s""",
    "suffix_lookup": f"""WITH req AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS name FROM part),
  p AS (SELECT page_id, url, {_PATH} AS path FROM pages),
  m AS (SELECT r.name, min(p.page_id) AS page_id FROM req r JOIN p ON ends_with(p.path, r.name) GROUP BY r.name)
SELECT r.name, m.page_id, CASE WHEN m.page_id IS NULL THEN 'not_found' ELSE 'found' END AS status
FROM req r LEFT JOIN m USING (name)""",
    "decode_quarantine": "SELECT page_id, 'ok' AS status, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages",
    # The fixture's lists are flat <ul><li><a ...>word</a></li></ul> blocks with
    # no entities or nesting, so a regex over the markup is a faithful oracle.
    "html_list_bullets": f"""WITH li AS (
    SELECT page_id, i AS pos,
           regexp_replace(regexp_replace(l[i], '<[^>]*>', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS item
    FROM (SELECT page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1) AS l FROM pages),
         range(1, len(l) + 1) t(i)),
  kept AS (SELECT page_id, pos, regexp_replace(item, '([a-z])(https?://|www\\.)', '\\1 \\2', 'g') AS item
           FROM li WHERE length(item) > 2),
  first AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(item) ORDER BY pos) AS rn FROM kept)
SELECT p.page_id, coalesce(b.bullets, '') AS bullets FROM pages p LEFT JOIN (
  SELECT page_id, string_agg('• ' || item, chr(10) ORDER BY pos) AS bullets FROM first WHERE rn = 1 GROUP BY page_id) b
USING (page_id)""",
    # Paragraphs: the body is cut before every <p> and every block tag; a
    # segment that starts with <p> runs to its first </p>. Its text is the
    # tag-free content (navigation test) and the stripped text nodes joined.
    "html_paragraphs": f"""WITH {_PARAS}
SELECT p.page_id, coalesce(k.text, '') AS text FROM pages p LEFT JOIN (
  SELECT page_id, string_agg(stripped, chr(10) || chr(10) ORDER BY i) AS text FROM keep GROUP BY page_id) k
USING (page_id)""",
    # First-generation document: paragraphs, then each non-empty <ul> as a
    # Python list literal (no quotes occur in the fixture's items), newline-
    # joined; links are counted inside the body.
    "page_document": f"""WITH {_PARAS},
  ptxt AS (SELECT page_id, string_agg(stripped, chr(10) || chr(10) ORDER BY i) AS text FROM keep GROUP BY page_id),
  ul AS (SELECT page_id, j, list_transform(regexp_extract_all(u[j], '<li[^>]*>(.*?)</li>', 1),
           lambda x: regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^{WS}+|{WS}+$', '', 'g')) AS items
         FROM (SELECT page_id, regexp_extract_all(body, '<ul[^>]*>(.*?)</ul>', 1) AS u FROM body),
              range(1, len(u) + 1) t(j)),
  lst AS (SELECT page_id, string_agg('[' || array_to_string(list_transform(items, lambda x: chr(39) || x || chr(39)), ', ')
                                     || ']', chr(10) ORDER BY j) AS lists
          FROM ul WHERE len(items) > 0 GROUP BY page_id),
  links AS (SELECT page_id, CAST(len(regexp_extract_all(body, '<a\\s[^>]*?href="([^"]*)"', 1)) AS INTEGER) AS n_links
            FROM body)
SELECT p.page_id, string_split({_PATH}, '/')[-1] AS page_name,
       concat_ws(chr(10), nullif(ptxt.text, ''), lst.lists) AS page_content, links.n_links
FROM pages p LEFT JOIN ptxt USING (page_id) LEFT JOIN lst USING (page_id) JOIN links USING (page_id)""",
    # The fixture uses only the entities &amp; &quot; &middot; &copy; (decoded
    # here, &amp; last) and no bare '<' in text, so tag splitting is faithful.
    "html_visible_text": f"""WITH h AS (
    SELECT page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS h
    FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'),
       lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
                                        '&amp;', '&'), '^{WS}+|{WS}+$', '', 'g')),
       lambda x: x <> ''), chr(10)) AS text
FROM h""",
    "html_list_items": f"""WITH ul AS (
    SELECT page_id, CAST(j - 1 AS INTEGER) AS list_no, u[j] AS body
    FROM (SELECT page_id, regexp_extract_all(html, '<ul[^>]*>(.*?)</ul>', 1) AS u FROM pages),
         range(1, len(u) + 1) t(j))
SELECT page_id, list_no, array_to_string(list_transform(regexp_extract_all(body, '<li[^>]*>(.*?)</li>', 1),
       lambda x: regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^{WS}+|{WS}+$', '', 'g')), '␟') AS items
FROM ul""",
}
