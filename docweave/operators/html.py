"""HTML extraction operators.

One Arrow pass (``parse_pages``) turns each page into ordered arrays (text
nodes with their paragraph, list items, table cells, links). Every operator
below is a Catalyst expression over those arrays, evaluated inside the row:
no operator here shuffles, because a page's parts never leave its row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text as tx
from docweave.functions.html_parse import PAGE_SCHEMA, parse_page
from docweave.plans.parallel import filter_computed, spread

# Parsed pages are many small Python objects: a task holds those of few pages.
PAGES_AT_ONCE = 128
_STR_LIST = pa.list_(pa.string())
_ARROW_FIELDS = [
    pa.field("nodes", pa.list_(pa.struct([("text", pa.string()), ("p", pa.int32())]))),
    pa.field("paras", pa.list_(_STR_LIST)),
    pa.field("lists", pa.list_(pa.struct([("kind", pa.string()), ("items", pa.list_(_STR_LIST))]))),
    pa.field("stray_items", pa.list_(_STR_LIST)),
    pa.field("tables", pa.list_(pa.list_(_STR_LIST))),
    pa.field("links", _STR_LIST),
]


def parse_pages(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None,
                body_only: bool = False) -> DataFrame:
    """pages -> one row per page with the parse arrays of ``PAGE_SCHEMA``.

    ``keep`` columns pass through. ``body_only`` parses only the text between
    ``<body>`` and ``</body>`` (the page loader of the first generation)."""
    keep = keep if keep is not None else [c for c in pages.columns if c != html_col]
    src = spread(pages).select(*keep, (tx.body_slice(F.col(html_col)) if body_only
                               else F.col(html_col)).alias("__html"))
    keep_schema = src.select(*keep).schema
    out_schema = T.StructType(keep_schema.fields + T._parse_datatype_string(PAGE_SCHEMA).fields)

    def run(batches):
        for batch in (b.slice(a, PAGES_AT_ONCE) for b in batches for a in range(0, b.num_rows, PAGES_AT_ONCE)):
            parsed = [parse_page(h) for h in batch.column("__html").to_pylist()]
            cols = [batch.column(k) for k in keep]
            names = list(keep)
            for f in _ARROW_FIELDS:
                cols.append(pa.array([p[f.name] for p in parsed], type=f.type))
                names.append(f.name)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, out_schema)


# -- text ---------------------------------------------------------------------

def visible_text(nodes: Column, separator: str = "\n", strip: bool = True) -> Column:
    """``get_text(separator, strip)`` over the text nodes."""
    texts = F.transform(nodes, lambda n: n["text"])
    if strip:
        texts = F.filter(F.transform(texts, tx.ustrip), lambda s: s != "")
    return F.array_join(texts, separator)


def _nav_flags(paras: Column, full: bool) -> Column:
    """One boolean per paragraph: its text matches a navigation pattern."""
    return F.transform(paras, lambda p: tx.nav_match(F.array_join(p, ""), full))


def paragraphs(paras: Column, min_len: int = 20) -> Column:
    """First generation main text: non-navigation ``<p>`` texts (stripped,
    concatenated strings) longer than ``min_len``, blank-line joined."""
    texts = F.transform(
        paras,
        lambda p: F.when(~tx.nav_match(F.array_join(p, "")),
                         F.array_join(F.transform(p, tx.ustrip), "")),
    )
    return F.array_join(
        F.filter(texts, lambda s: s.isNotNull() & (F.length(s) > min_len)), "\n\n"
    )


def block_text_raw(nodes: Column, paras: Column) -> Column:
    """Second generation raw text: text nodes outside navigation paragraphs,
    space-joined and whitespace-normalised."""
    nav = _nav_flags(paras, full=True)  # indexed by the node's paragraph number
    kept = F.filter(nodes, lambda n: (n["p"] < 0) | ~F.get(nav, n["p"]))
    return tx.normalize_whitespace(F.array_join(F.transform(kept, lambda n: n["text"]), " "))


def clean_block_text(raw: Column, product: str | None = None, version: str | None = None) -> Column:
    """The cleaning chain applied to block text (``product`` / ``version``:
    the help system's own name phrases to delete, if any)."""
    t = tx.collapse_repeated_phrases(raw)
    t = tx.strip_fillers(t, product, version)
    t = tx.collapse_ellipsis(t)
    return tx.regroup_paragraphs(t)


def block_text(nodes: Column, paras: Column, product: str | None = None,
               version: str | None = None) -> Column:
    return clean_block_text(block_text_raw(nodes, paras), product, version)


# -- lists --------------------------------------------------------------------

def _strip_join(item: Column, sep: str) -> Column:
    """``get_text(sep, strip=True)`` of one element's strings."""
    return F.array_join(F.filter(F.transform(item, tx.ustrip), lambda s: s != ""), sep)


def list_items(lists: Column) -> Column:
    """First generation: one array of item texts per ``<ul>`` (``ARRAY<ARRAY>``)."""
    uls = F.filter(lists, lambda l: l["kind"] == "ul")
    return F.transform(uls, lambda l: F.transform(l["items"], lambda it: _strip_join(it, "")))


def _dedupe_ci(items: Column) -> Column:
    """Keep the first item of each lower(trim(item)) key, in order. Sorting
    (key, position) pairs makes it O(n log n): the first pair of each key run
    is the first occurrence; its positions, sorted, pick the kept items."""
    srt = F.array_sort(F.transform(items, lambda x, i: F.struct(
        F.lower(tx.ustrip(x)).alias("k"), i.alias("i"))))
    prev = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int>")),
                    F.slice(srt, 1, F.greatest(F.size(srt) - 1, F.lit(0))))
    pairs = F.arrays_zip(srt.alias("cur"), prev.alias("prev"))
    firsts = F.filter(F.transform(pairs, lambda p: F.when(
        p["prev"].isNull() | (p["prev"]["k"] != p["cur"]["k"]), p["cur"]["i"])), lambda v: v.isNotNull())
    return F.transform(F.array_sort(firsts), lambda j: F.get(items, j))


def list_bullets(lists: Column, stray_items: Column) -> Column:
    """Second generation bullets: items of every ``ul``/``ol`` (nested items
    repeat), stripped text longer than 2 chars; stray ``li`` when no list
    yields any; URL spacing; case-insensitive first-wins de-dup; ``"• "``."""
    def good(items):
        return F.filter(items, lambda it: F.length(_strip_join(it, "")) > 2)

    in_lists = good(F.flatten(F.transform(lists, lambda l: l["items"])))
    chosen = F.when(F.size(in_lists) > 0, in_lists).otherwise(good(stray_items))
    texts = F.transform(chosen, lambda it: tx.space_before_url(_strip_join(it, " ")))
    kept = _dedupe_ci(texts)
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("• "), s)), "\n")


# -- tables -------------------------------------------------------------------

def _is_nav_table(table: Column, allowed: list[str]) -> Column:
    cells = F.transform(F.flatten(table), lambda c: F.lower(tx.ustrip(c)))
    return F.size(F.array_except(cells, F.array(*[F.lit(a) for a in allowed]))) == 0


def content_tables(tables: Column, short_nav: bool = False) -> Column:
    """Tables that are not navigation-only (cell set within the nav set)."""
    allowed = tx.NAV_TABLE_CELLS_SHORT if short_nav else tx.NAV_TABLE_CELLS
    return F.filter(tables, lambda t: ~_is_nav_table(t, allowed))


def table_text(tables: Column) -> Column:
    """Second generation: rows ``" | "``-joined (dropping empty, back/forward
    only, and pipe-only rows), newline between rows, blank line between
    tables, blank-line runs squeezed, stripped."""
    def row_text(r):
        return tx.ustrip(F.array_join(r, " | "))

    def keep_row(r):
        rt = row_text(r)
        all_nav = F.forall(r, lambda c: F.lower(c).isin("back", "forward"))
        return (rt != "") & ~all_nav & ~rt.rlike(r"^(\s*\|\s*)+$")

    per_table = F.transform(
        tables, lambda t: F.array_join(F.transform(F.filter(t, keep_row), row_text), "\n")
    )
    joined = F.array_join(F.filter(per_table, lambda s: s != ""), "\n\n")
    return tx.ustrip(tx.squeeze_blank_lines(joined))


def table_grid(table: Column) -> Column:
    """One table as a fixed-width grid, first row as header (left-aligned,
    one space padding, ``=`` rule under the header). Rows are padded to the
    widest row with empty cells."""
    ncols = F.aggregate(table, F.lit(0), lambda acc, r: F.greatest(acc, F.size(r)))
    idx = F.sequence(F.lit(0), ncols - 1)
    padded = F.transform(table, lambda r: F.transform(idx, lambda j: F.coalesce(
        F.get(r, j), F.lit(""))))
    widths = F.transform(idx, lambda j: F.aggregate(
        padded, F.lit(0), lambda acc, r: F.greatest(acc, F.length(F.get(r, j)))))

    def rule(ch):
        return F.concat(F.lit("+"), F.array_join(
            F.transform(widths, lambda w: F.repeat(F.lit(ch), w + 2)), "+"), F.lit("+"))

    def line(r):
        return F.concat(F.lit("| "), F.array_join(F.transform(
            idx, lambda j: F.rpad(F.get(r, j), F.get(widths, j), " ")), " | "), F.lit(" |"))

    header = F.get(padded, 0)
    body = F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0)))
    body_lines = F.transform(body, lambda r: F.concat(line(r), F.lit("\n"), rule("-")))
    return F.when(F.size(table) == 0, F.lit("")).otherwise(F.concat(
        rule("-"), F.lit("\n"), line(header), F.lit("\n"), rule("="),
        F.when(F.size(body) > 0, F.concat(F.lit("\n"), F.array_join(body_lines, "\n")))
        .otherwise(F.lit("")),
    ))


def tables_as_grids(tables: Column) -> Column:
    """First-generation tables as grids, blank-line joined: tables whose cells
    are all within {back, forward} or all empty are dropped; two-column
    tables drop all-empty rows."""
    def two_col_fix(t):
        return F.when(
            F.forall(t, lambda r: F.size(r) == 2),
            F.filter(t, lambda r: F.exists(r, lambda c: c != "")),
        ).otherwise(t)

    kept = F.filter(content_tables(tables, short_nav=True),
                    lambda t: F.exists(F.flatten(t), lambda c: tx.ustrip(c) != ""))
    grids = F.transform(kept, lambda t: table_grid(two_col_fix(t)))
    return F.array_join(F.filter(grids, lambda g: g != ""), "\n\n")


# -- documents ----------------------------------------------------------------

def _escapes() -> dict[str, str]:
    """Rule-built: controls, format marks and separators (all but the blank)
    up to U+3000 as Python writes them inside a string literal."""
    import unicodedata
    hidden = (chr(cp) for cp in range(0x3001) if cp != 0x20 and unicodedata.category(chr(cp)) in ("Cc", "Cf", "Zs", "Zl", "Zp"))
    return {"\\": "\\\\"} | {ch: repr(ch)[1:-1] for ch in hidden}


_ESCAPES = _escapes()
_HIDDEN = r"[\\\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _py_list_repr(items: Column) -> Column:
    """``str(list_of_str)``: items in single quotes, in double quotes when they
    hold a single but no double quote; backslashes and invisible characters are
    escaped."""
    table = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def quoted(s: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(s, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
        body = F.when(s.rlike(_HIDDEN), spelled).otherwise(s)
        single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
        return (F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
                .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def page_document(parsed: DataFrame, options: list[str] = ("text", "table", "list"),
                  page_name: Column | None = None) -> DataFrame:
    """First generation document: chosen parts in text, table, list order,
    empties dropped, newline-joined; links and page name as metadata."""
    parts = []
    if "text" in options:
        parts.append(F.array(paragraphs(F.col("paras"))))
    if "table" in options:
        parts.append(F.array(tables_as_grids(F.col("tables"))))
    if "list" in options:
        parts.append(F.transform(
            F.filter(list_items(F.col("lists")), lambda l: F.size(l) > 0), _py_list_repr))
    allparts = F.filter(F.concat(*parts), lambda s: s.isNotNull() & (s != "")) if parts \
        else F.array().cast("array<string>")
    return parsed.select(
        "page_id",
        (page_name if page_name is not None else F.col("page_name")).alias("page_name"),
        F.array_join(allparts, "\n").alias("page_content"),
        F.col("links"),
    )


def page_document_full(parsed: DataFrame, header_col: str = "url", product: str | None = None,
                       version: str | None = None) -> DataFrame:
    """Second generation document: cleaned text -> URL spacing -> entity
    spacing -> punctuation -> filler sentences; then bullets; then table
    text; non-empty parts blank-line joined; empty pages dropped; with a
    ``===== FILE: <name> =====`` header for the processed corpus."""
    t = block_text(F.col("nodes"), F.col("paras"), product, version)
    t = tx.space_before_url(t)
    t = tx.space_entities(t)
    t = tx.fix_punctuation_spacing(t)
    t = tx.drop_filler_sentences(t)
    parts = F.array(t, list_bullets(F.col("lists"), F.col("stray_items")), table_text(F.col("tables")))
    parts = F.filter(F.transform(parts, tx.ustrip), lambda s: s != "")
    content = F.array_join(parts, "\n\n")
    docs = parsed.select("page_id", F.col(header_col).alias("source"), content.alias("content"))
    return (filter_computed(docs, F.col("content") != "")
            .withColumn("block", F.concat(F.lit("===== FILE: "), F.col("source"),
                                          F.lit(" =====\n"), F.col("content"))))


def table_rows(parsed: DataFrame) -> DataFrame:
    """Long form ``(page_id, table_no, row_no, cells)``, 1-based numbers."""
    return (parsed.select("page_id", F.posexplode("tables").alias("t0", "table"))
            .select("page_id", (F.col("t0") + 1).alias("table_no"),
                    F.posexplode("table").alias("r0", "cells"))
            .select("page_id", "table_no", (F.col("r0") + 1).alias("row_no"), "cells"))


def table_pairs(parsed: DataFrame) -> DataFrame:
    """Two-cell rows with both cells non-empty -> (entity, limit)."""
    rows = table_rows(parsed).filter(F.size("cells") == 2)
    return (rows.select("page_id", "table_no", "row_no",
                        F.get("cells", 0).alias("entity"), F.get("cells", 1).alias("limit"))
            .filter((F.col("entity") != "") & (F.col("limit") != "")))
