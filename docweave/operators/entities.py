"""Names of several words, found in the corpus and tagged in its texts.

Runs of capitalised words between single blanks give n-grams of two to four
words. One is a name if it is frequent enough and each neighbouring pair in it
occurs ``RATIO`` times as often as its words would by chance. Tagging joins each
capitalised pair of a text with the names that start with it (a trie cut by its
first two words, so that no first word is a hot key) and takes the leftmost,
then longest. Expressions, joins and grouped counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import written

LONGEST, LEAST, RATIO = 4, 3, 4.0
_WORD = r"[\p{L}\p{N}]+"
_GLUED = rf"{_WORD}(?: (?=[\p{{L}}\p{{N}}]))?"
_CAPITAL = r"\p{Lu}[\p{L}\p{N}]*+"
_RUN = rf"(?<![\p{{L}}\p{{N}}]){_CAPITAL}(?: {_CAPITAL})*"


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def tokens(text: Column) -> Column:
    """The words of a text; a blank at the end of one glues the next to it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_GLUED), F.lit(0))


def runs(text: Column) -> Column:
    """The longest runs of capitalised words between single blanks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUN), F.lit(0))


def _grams(w: Column, n: int) -> Column:
    """``(k, g)`` of the n-grams of a run's words."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("k"), F.array_join(F.slice(w, i, n), " ").alias("g")))


def multiword_names(docs: DataFrame, text_col: str = "text", *, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """``(name, n_words, n, ratio)``: the ratio is the smallest of the pairs
    in the name."""
    words = docs.select(F.explode(runs(F.col(text_col))).alias("run")).select(F.split("run", " ").alias("t"))
    grams = F.concat(*[_grams(F.col("t"), k) for k in range(1, LONGEST + 1)])
    counts = written(words.select(F.explode(grams).alias("x")).select("x.*").groupBy("k", "g").agg(F.count(F.lit(1)).alias("n")), "grams")
    one = counts.filter("k = 1")
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    word = lambda c: one.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}"))
    two = counts.filter("k = 2").select("g", "n", F.get(F.split("g", " "), 0).alias("a"), F.get(F.split("g", " "), 1).alias("b"))
    pairs = written(two.join(word("a"), "a").join(word("b"), "b").select(
        F.col("g").alias("pair"), (F.col("n") * total / (F.col("n_a") * F.col("n_b"))).alias("ratio")).filter(F.col("ratio") >= ratio), "pairs")
    held = counts.filter((F.col("k") > 1) & (F.col("n") >= least)).withColumn("w", F.split("g", " "))
    inside = held.select("g", "k", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("pair"))
    # a pair may stand twice in a name: all of its k - 1 places must hold
    good = inside.join(pairs, "pair").groupBy("g", "k", "n").agg(F.count(F.lit(1)).alias("held"), F.min("ratio").alias("ratio"))
    return good.filter(F.col("held") == F.col("k") - 1).select(F.col("g").alias("name"), F.col("k").alias("n_words"), "n", "ratio")


def tagged(df: DataFrame, names: DataFrame, text_col: str = "text", out: str = "entities") -> DataFrame:
    """Adds the entities of each text in order: names of several words, and
    capitalised words of two letters or more outside of them. Null holds
    none; rows of equal text share the work."""
    key = F.struct(F.xxhash64(text_col).alias("a"), F.md5(F.col(text_col).cast("binary")).alias("b"))
    keyed = df.withColumn("__text", key)
    texts = keyed.select("__text", tokens(F.col(text_col)).alias("t")).dropDuplicates(["__text"])
    texts = written(texts, "tokens")
    t = F.col("t")
    starts = F.filter(F.when(F.size(t) >= 2, F.sequence(F.lit(1), F.size(t) - 1)).otherwise(F.array().cast("array<int>")),
                      lambda i: F.get(t, i - 1).endswith(" ") & _capital(F.get(t, i - 1)) & _capital(F.get(t, i)))
    asked = texts.select("__text", "t", F.explode(starts).alias("i")).select(
        "__text", "i", F.slice("t", F.col("i"), LONGEST).alias("ahead"),
        F.rtrim(F.array_join(F.slice("t", F.col("i"), 2), "")).alias("head"))
    trie = names.select(F.array_join(F.slice(F.split("name", " "), 1, 2), " ").alias("head"), "name", "n_words")
    # words that aren't glued together lack the blank between them
    hits = asked.join(trie, "head").filter(F.rtrim(F.array_join(F.slice("ahead", F.lit(1), F.col("n_words")), "")) == F.col("name"))
    spans = hits.groupBy("__text").agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("n_words")).alias("k"), "name"))).alias("s"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,k:int,name:string>>").alias("got"))
    taken = F.aggregate("s", start, lambda acc, x: F.when(x["i"] >= acc["next"], F.struct(
        (x["i"] - x["k"]).alias("next"), F.array_append(acc["got"], F.struct(x["i"].alias("i"), x["k"].alias("k"), x["name"].alias("name"))).alias("got"))).otherwise(acc))
    found = texts.join(spans.select("__text", taken["got"].alias("got")), "__text", "left").withColumn(
        "got", F.coalesce("got", F.array().cast("array<struct<i:int,k:int,name:string>>")))
    places = F.when(F.size(t) >= 1, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
    single = F.filter(places, lambda i: _capital(F.get(t, i - 1)) & (F.length(F.rtrim(F.get(t, i - 1))) >= 2)
                      & ~F.exists("got", lambda g: (i >= g["i"]) & (i < g["i"] - g["k"])))
    every = F.array_sort(F.concat(F.transform(single, lambda i: F.struct(i.alias("i"), F.rtrim(F.get(t, i - 1)).alias("e"))),
                                  F.transform("got", lambda g: F.struct(g["i"].alias("i"), g["name"].alias("e")))))
    held = found.select("__text", F.transform(every, lambda x: x["e"]).alias(out))
    return keyed.join(held, keyed["__text"].eqNullSafe(held["__text"]), "left").select(*df.columns, out)


def entity_edges(df: DataFrame, col: str = "entities") -> DataFrame:
    """Distinct ``(src, dst)`` of neighbouring entities in a text."""
    e = F.col(col)
    at = F.when(F.size(e) >= 2, F.sequence(F.lit(1), F.size(e) - 1)).otherwise(F.array().cast("array<int>"))
    pairs = df.select(F.explode(F.transform(at, lambda i: F.struct(F.get(e, i - 1).alias("a"), F.get(e, i).alias("b")))).alias("p"))
    return pairs.select(F.least("p.a", "p.b").alias("src"), F.greatest("p.a", "p.b").alias("dst")).distinct()
