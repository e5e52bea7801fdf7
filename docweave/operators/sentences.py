"""Sentence boundaries learnt from the corpus itself, without marked text
(the published method of Kiss and Strunk).

Grouped counts over all texts tell which types keep their full stop
(abbreviations, by a log-likelihood ratio scaled by length, inner stops and
stopless uses), which words follow stops more often than chance (starters),
which pairs hold together across a stop (collocations) and in what case a word
stands inside sentences. From these every distinct pair of a type with a stop
and its next word is judged once; texts then join their own pairs with the
judged ones, so the model may be as large as the vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import written

# Thresholds of the published method.
ABBREVIATION, STARTER, COLLOCATION, STOP_SHARE = 0.3, 30.0, 7.88, 0.99

_OPEN, _CLOSE = "\"'`([{<«“‘¿¡", "\"'`)]}>»”’,;:"
_DIGITS = re.compile(r"\d+")
_LAST = frozenset(".?!" + _CLOSE)
# a word that a single or last full stop may belong to, and the word after it
_STOP = re.compile(rf"(?<!\S)(\S*\.[{re.escape(_CLOSE)}]*+)\s+(?=(\S+))")
_FLUSH = 1 << 17


def parsed(token: str) -> tuple[str, str, bool, bool]:
    """``(type, case, stop, end)`` of a token: lower-case form without its
    last stop, digits as 0; case ``U``, ``L`` or ``-`` of the first letter; a
    single final full stop; any final mark that may end a sentence."""
    core = token.lstrip(_OPEN).rstrip(_CLOSE)
    end = core.endswith((".", "?", "!"))
    stop = core.endswith(".") and not core.endswith("..")
    plain = core.rstrip(".?!")
    first = plain[:1]
    case = "U" if first.isupper() else "L" if first.islower() else "-"
    kind = plain.lower()
    return kind if kind.isalpha() else _DIGITS.sub("0", kind), case, stop, end


class Counts:
    """Counts of ``(kind, type, next, case)``: ``w`` words without and ``s``
    with a stop, ``m`` words inside a sentence by case, ``p`` pairs across a
    stop. Words are counted as they stand and parsed once each in ``rows``."""

    def __init__(self):
        self.words: Counter = Counter()
        self.opening: Counter = Counter()  # words that no word of the same sentence precedes
        self.pairs: Counter = Counter()

    def __len__(self) -> int:
        return len(self.words) + len(self.pairs)

    def add(self, text: str) -> None:
        words = text.split()
        self.words.update(words)
        self.opening.update(words[:1])
        for word, following in zip(words, words[1:]):
            if word[-1] in _LAST:
                mark = word.rstrip(_CLOSE)[-1:]
                if mark and mark in ".?!":
                    self.opening[following] += 1
                    if mark == ".":
                        self.pairs[word, following] += 1

    def rows(self) -> Counter:
        out: Counter = Counter()
        found = {word: parsed(word) for word in self.words}
        for word, n in self.words.items():
            kind, case, stop, _ = found[word]
            out["s" if stop else "w", kind, "", ""] += n
            if inside := n - self.opening[word]:
                out["m", kind, "", case] += inside
        for (word, following), n in self.pairs.items():
            kind, case, _, _ = found[following]
            if found[word][2]:
                out["p", found[word][0], kind, case] += n
        return out


_COUNTS = "kind string, type string, next string, case string, n long"


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """The summed counts; each task adds up what it has seen first."""
    def run(batches):
        held = Counts()

        def batch_of(found):
            keys = list(found)
            return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(4)],
                                               pa.array([found[k] for k in keys], pa.int64())], names=["kind", "type", "next", "case", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.add(t or "")
                if len(held) > _FLUSH:
                    yield batch_of(held.rows())
                    held = Counts()
        yield batch_of(held.rows())

    each = docs.select(F.col(text_col).alias("t")).mapInArrow(run, _COUNTS)
    return written(each.groupBy("kind", "type", "next", "case").agg(F.sum("n").alias("n")), "sentences")


def _ratio(both: Column, a: Column, b: Column, n) -> Column:
    """Dunning's log-likelihood ratio that ``b`` is more (or less) frequent
    with ``a``: counts of both, of each, and of all."""
    def part(k, m, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    rest = F.greatest(n - a, F.lit(1.0))
    p, p1, p2 = b / n, both / a, F.greatest(b - both, F.lit(0.0)) / rest
    return -2.0 * (part(both, a, p) + part(b - both, rest, p) - part(both, a, p1) - part(b - both, rest, p2))


def abbreviations(counts: DataFrame) -> DataFrame:
    """``(type, score)`` of the types whose stop belongs to them."""
    words = counts.filter("kind in ('w', 's') and type <> ''").groupBy("type").agg(
        F.sum(F.when(F.col("kind") == "s", F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("w"))
    words = written(words, "sentence_words")
    stops, every = words.agg(F.sum("s").cast("double")).scalar(), words.agg(F.sum(F.col("s") + F.col("w")).cast("double")).scalar()
    p = stops / F.greatest(every, F.lit(1.0))
    ratio = -2.0 * (F.col("s") * F.log(p) + F.col("w") * F.log(1 - p) - F.col("s") * F.log(F.lit(STOP_SHARE)) - F.col("w") * F.log(F.lit(1 - STOP_SHARE)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("w"))
    found = words.filter((F.col("s") > 0) & (p < 1))
    return found.filter(F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike(r"^\p{L}$")).select("type", score.alias("score")).filter(
        F.col("score") >= ABBREVIATION)


def joined_pairs(counts: DataFrame) -> DataFrame:
    """``(type, next, case)``: a stop after ``type`` and before ``next`` in
    that case ends no sentence."""
    short = written(abbreviations(counts).select("type", F.lit(True).alias("short")), "abbreviations")
    total = counts.filter("kind in ('w', 's')").groupBy("type").agg(F.sum("n").alias("n"))
    n = F.greatest(total.agg(F.sum("n")).scalar().cast("double"), F.lit(1.0))
    pairs = written(counts.filter("kind = 'p'").select("type", "next", "case", "n").join(short, "type", "left").withColumn(
        "form", F.when(F.col("short"), "abbreviation").when(F.col("type").rlike(r"^\p{L}$"), "initial")
        .when(F.col("type").rlike(r"^0+$"), "number").otherwise("word")).drop("short"), "stops")
    # starters: words that follow the stops of ordinary words
    breaks = pairs.filter("form = 'word'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()
    starts = pairs.filter("form = 'word' and next <> ''").groupBy(F.col("next").alias("type")).agg(F.sum("n").cast("double").alias("after")).join(
        total.select("type", F.col("n").cast("double").alias("of")), "type")
    starter = starts.filter((_ratio(F.col("after"), F.greatest(breaks, F.lit(1.0)), F.col("of"), n) >= STARTER)
                            & (F.col("after") / breaks > F.col("of") / n)).select(F.col("type").alias("next"), F.lit(True).alias("starter"))
    inside = counts.filter("kind = 'm'").groupBy(F.col("type").alias("next")).agg(
        F.sum(F.when(F.col("case") == "U", F.col("n")).otherwise(0)).alias("upper"), F.sum(F.when(F.col("case") == "L", F.col("n")).otherwise(0)).alias("lower"))
    # collocations across a stop, of types that often keep theirs
    across = pairs.filter("form <> 'word' and next <> ''").groupBy("type", "next").agg(F.sum("n").cast("double").alias("both"))
    size = total.select("type", F.col("n").cast("double").alias("a"))
    tied = across.join(size, "type").join(size.toDF("next", "b"), "next").filter(
        (F.col("both") > 1) & (_ratio(F.col("both"), F.col("a"), F.col("b"), n) >= COLLOCATION) & (F.col("both") / F.col("a") > F.col("b") / n)).select(
        "type", "next", F.lit(True).alias("tied"))
    judged = pairs.join(starter, "next", "left").join(inside, "next", "left").join(tied, ["type", "next"], "left")
    new = (F.col("case") == "U") & (F.coalesce("lower", F.lit(0)) > 0) & (F.coalesce("upper", F.lit(0)) == 0)
    starts_here = (F.col("case") == "U") & F.coalesce("starter", F.lit(False))
    goes_on = (F.when(F.col("form") == "word", F.lit(False))
               .when(F.col("case") == "L", F.lit(True))
               .when(F.col("form") == "number", F.lit(False))
               .when(F.coalesce("tied", F.lit(False)) & ~starts_here, F.lit(True))
               .when(F.col("form") == "initial", ~new)
               .otherwise(~(new | starts_here)))
    return written(judged.filter(goes_on).select("type", "next", "case"), "joined_pairs")


def sentence_model(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The judged pairs, learnt from all texts of ``docs``."""
    return joined_pairs(corpus_counts(docs, text_col))


def with_inner_stops(df: DataFrame, model: DataFrame, text_col: str = "text", out: str = "inner") -> DataFrame:
    """Adds the offsets after those stops (and their blanks) that end no
    sentence. Rows with equal text share the work."""
    key = F.struct(F.xxhash64(text_col).alias("a"), F.md5(F.col(text_col).cast("binary")).alias("b"))
    keyed = df.withColumn("__text", key)
    schema = T.StructType([T.StructField("__text", keyed.schema["__text"].dataType), T.StructField("at", T.IntegerType()),
                           *[T.StructField(n, T.StringType()) for n in ("type", "next", "case")]])

    def run(batches):
        for batch in batches:
            rows, at, parts = [], [], ([], [], [])
            for r, t in enumerate(batch.column("t").to_pylist()):
                for m in _STOP.finditer(t or ""):
                    word, following = m.groups()
                    kind, _, stop, _ = parsed(word)
                    if stop:
                        rows.append(r)
                        at.append(m.end())
                        for c, v in zip(parts, (kind, *parsed(following)[:2])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("__text").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()),
                                              *[pa.array(c, pa.string()) for c in parts]], names=["__text", "at", "type", "next", "case"])

    texts = keyed.select("__text", F.col(text_col).alias("t")).filter("t is not null").dropDuplicates(["__text"])
    held = texts.mapInArrow(run, schema).join(model, ["type", "next", "case"]).groupBy("__text").agg(F.sort_array(F.collect_list("at")).alias(out))
    return keyed.join(held, "__text", "left").drop("__text").withColumn(out, F.coalesce(out, F.array().cast("array<int>")))


def split_learnt(df: DataFrame, model: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``(ids, sentence_no, sentence)``: texts cut after ``.``, ``?`` or ``!``
    and blanks, but not at inner stops; blank sentences are left out."""
    end = r"(?<=[.?!])\s+"
    src = with_inner_stops(df.select(*id_cols, text_col), model, text_col)

    schema = T.StructType([*src.select(*id_cols).schema.fields, T.StructField("sentence_no", T.IntegerType()), T.StructField("sentence", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, nos, out = [], [], []
            for r, (t, inner) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column("inner").to_pylist())):
                for no, s in enumerate(sentences(t or "", end, set(inner))):
                    rows.append(r)
                    nos.append(no)
                    out.append(s)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in id_cols], pa.array(nos, pa.int32()), pa.array(out, pa.string())],
                                             names=[*id_cols, "sentence_no", "sentence"])

    return src.mapInArrow(run, schema)


def sentences(text: str, end: str, inner: set[int]) -> list[str]:
    cuts = [0, *[m.end() for m in re.finditer(end, text) if m.end() not in inner], len(text)]
    return [s for s in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if s]
