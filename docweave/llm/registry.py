"""Registered queries of this folder: ``opN_<name>`` for each operator, with
production parameters over whole tables, and the DuckDB SQL of those that SQL
can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import debruijn as db
from docweave.llm import decontaminate as dc
from docweave.llm import exact_dedup as xd
from docweave.llm import jaccard_join as jj
from docweave.llm import language_id as li
from docweave.llm import license_scan as ls
from docweave.llm import mixture_shards as ms
from docweave.llm import quality_lm as ql
from docweave.llm import sentencepiece_codec as sp
from docweave.llm import spelling
from docweave.llm import suffix_dedup as sd
from docweave.llm import token_alignment as ta
from docweave.llm import warc
from docweave.session import scratch_dir, table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = dc.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "row.doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit.items"), ",").cast("binary"), 256).alias("items_sha256"),
        dc.contaminated().alias("contaminated"))


def op2_sentencepiece(spark: SparkSession, sf: str, model_path: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = sp.encode_decode(docs, sp.load_model_bytes(model_path))
    return coded.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        sp.ids_digest("ids").alias("ids_sha256"), F.col("exact").alias("round_trip"))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages with all evidence, and documents with text and source; one
    row for each, ``doc_id`` or ``page_id`` being null."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    evidence = li.page_evidence(pages).withColumn("kind", F.lit("page")).unionByName(
        li.text_evidence(docs).withColumn("kind", F.lit("document")))
    found = li.identify(evidence, li.fit_text_model(docs))
    return found.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
                        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
                        "lang", F.round("confidence", 3).alias("confidence"), "text_lang", "declared", "host")


def op4_debruijn(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return db.remove_repeated_words(docs).select("row.doc_id", "n_words", "n_removed",
                                                 F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return jj.jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op6_quality_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = ql.QualityModel(docs, table(spark, sf, "labels"), folds=ql.FOLDS).classify(docs)
    return found.select("row.doc_id", "row.lang", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"),
                        "rejected")


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    path = scratch_dir(spark, "warc")
    warc.write_archive(warc.resolve_revisits(warc.with_payload(pages, "page_id", "html", "url")), path)
    return warc.read_archive(spark, path).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sd.remove_earlier_substrings(docs).select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                                     F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ls.scan_licenses(docs).select(F.col("id").alias("doc_id"), "kind", F.col("unit_no").cast("long").alias("unit_no"),
                                         "license", F.round("dice", 4).alias("dice"))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return xd.exact_dedup(docs, "doc_id", "text", keep="max").withColumnRenamed("id", "doc_id")


def op11_mixture_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", ms.text_size(F.col("text")).alias("size"),
                                                ms.text_crc(F.col("text")).alias("text_crc32"))
    found = ms.interleave(docs, tie=F.struct("text_crc32", "size"))
    return found.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "row.source")


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(docs))


def op13_token_alignment(spark: SparkSession, sf: str, byte_bpe: str = BYTE_TOKENIZER, pieces: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = ta.link_statistics(docs, ta.read_file(byte_bpe), ta.read_file(pieces))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_debruijn": op4_debruijn,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_lm": op6_quality_lm,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_mixture_shards": op11_mixture_shards,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

_CRC_TABLE = """bits(k, t) AS (SELECT 0, [x::BIGINT for x in range(256)] UNION ALL
    SELECT k + 1, [CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END for x in t] FROM bits WHERE k < 8),
  crc AS (SELECT t FROM bits WHERE k = 8)"""


def _crc_sql(x: str) -> str:
    """Unsigned CRC-32 of a string, with the table ``t`` of ``_CRC_TABLE``."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({x})), '..'), "
            "lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295::BIGINT)")


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((h{k // 8} >> {35 - 5 * (k % 8)}) & 31 AS INTEGER), 1)" for k in range(32))

_TEMPLATES = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in ls.template_bigrams(text)))
                       for name, text in sorted(ls.TEMPLATES.items()))

ORACLE = {
    "op1_decontaminate": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, {_AZ}), '{_WORD_CHARS}') AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
  dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_AZ}), '{_WORD_CHARS}'), []) AS w FROM documents),
  ks AS (SELECT DISTINCT k FROM win),
  dg AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)),
  m AS (SELECT dg.doc_id, dg.s, dg.k, win.item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
  it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op4_debruijn": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
  r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
  m AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM g SEMI JOIN r USING (h)),
  t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
  k AS (SELECT t.doc_id, count(m.p) AS n_removed, coalesce(string_agg(CASE WHEN m.p IS NULL THEN x END, ' ' ORDER BY t.p), '') AS kept
        FROM t LEFT JOIN m USING (doc_id, p) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  m AS (SELECT a, min(b) AS first FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.first, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id""",
    "op7_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
  d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p),
  q AS (SELECT *, {', '.join(f"CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT) AS h{i}" for i in range(4))} FROM d)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  g AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS h
        FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS s FROM d WHERE len(x) >= 100)),
  f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
  m AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM g JOIN f USING (h) WHERE doc_id > first),
  t AS (SELECT doc_id, x, unnest(range(0, len(x) // 2)) AS p FROM d),
  b AS (SELECT t.doc_id, t.p, m.p IS NOT NULL AS gone, substr(x, 2 * t.p + 1, 2) AS y FROM t LEFT JOIN m USING (doc_id, p)),
  r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM b),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
               coalesce(string_agg(CASE WHEN NOT gone THEN y END, '' ORDER BY p), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op9_license_scan": rf"""
WITH tpl(name, grams) AS (VALUES {_TEMPLATES}),
  d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  u AS (SELECT doc_id, 'line' AS kind, unnest(range(len(x))) AS unit_no, unnest(x) AS unit
        FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)
        UNION ALL
        SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(x))), unnest(x) AS unit
                       FROM (SELECT doc_id, string_split_regex(t, '\n[ \t\r]*\n') AS x FROM d)) WHERE contains(unit, chr(10))),
  w AS (SELECT doc_id, kind, unit_no,
               string_split(trim(regexp_replace(translate(unit, {_AZ}), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM u),
  g AS (SELECT doc_id, kind, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
        FROM w WHERE len(w) > 1),
  s AS (SELECT doc_id, kind, unit_no, name, len(list_intersect(g.grams, tpl.grams)) AS c, len(g.grams) + len(tpl.grams) AS n FROM g, tpl),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, unit_no ORDER BY 2.0 * c / n DESC, name) AS k FROM s WHERE 200 * c >= 80 * n)
SELECT doc_id, kind, unit_no, name AS license, round(2.0 * c / n, 4) AS dice FROM r WHERE k = 1""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_mixture_shards": f"""
WITH RECURSIVE {_CRC_TABLE},
  d AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32
        FROM documents, crc),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('{ms.SEED}:' || doc_id), doc_id, text_crc32, size) - 1 AS r,
               count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
  o AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, md5('{ms.SEED}:' || coalesce('+' || source, '-')), r) - 1 AS pos FROM r),
  c AS (SELECT *, CAST({ms.SHARDS} * pos // total AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard,
       pos - (shard * total + {ms.SHARDS - 1}) // {ms.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM c""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
  u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS x FROM documents),
  l AS (SELECT doc_id, translate(x, {_AZ}) AS x FROM u WHERE length(x) >= 7),
  h AS (SELECT x, {_crc_sql("doc_id || ':' || x")} AS h FROM l, crc),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word FROM h),
  v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
  p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
  e AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM p),
  s AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM p),
  m AS (SELECT a.word, b.word AS near, b.n FROM s a JOIN s b ON a.k = b.k AND a.word <> b.word
        UNION ALL SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.k
        UNION ALL SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.k),
  c AS (SELECT word, count(*) AS n_near, max(n) AS top FROM m GROUP BY word),
  b AS (SELECT word, n_near, top, min(near) AS near FROM m JOIN c USING (word) WHERE m.n = top GROUP BY ALL),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN near END AS form,
               CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN b USING (word)),
  z AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT z.word, f.form, k + 1 FROM z JOIN f ON f.word = z.root AND f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(z.root, z.k) AS root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word GROUP BY ALL""",
}
