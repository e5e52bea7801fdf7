"""Quality classifier: interpolated modified Kneser-Ney character n-grams.

One model per language is trained on all trusted documents. Each task counts its
n-grams and sends one row per distinct one; a grouped aggregation sums them, and
shards of the n-gram table join counts, continuation counts, discounts and
context sums of every order into the probability of each n-gram that any
document holds. Scoring then looks n-grams up in tables of at most ``SHARD``
entries, one pass over the texts for each shard (the
log-probability of a document is a sum, so shards add up). The texts are never
shuffled. A document's perplexity, shrunk towards the mean of its language by
``SHRINK`` characters so that few words don't decide, is compared with a quantile
of the perplexity of the trusted documents of its language, from an exact histogram.

With ``folds`` that perplexity is of held-out texts: trusted documents are dealt
into folds by a hash of their text (equal texts share one) and each fold is scored by a
model of the others, since perplexity on the model's own training text is too
low and would reject clean documents that it wasn't trained on. A language with text in one fold
only is scored by the others' model of all languages. ``drop_low_quality`` holds out.

Characters are classes of 12 bits: code points below 3072 themselves, others
hashed into the 1024 classes above, which keeps the number of n-grams sublinear.

Defined cases: null and empty texts have no perplexity and are rejected;
languages (null is one) without trusted text are scored by a model of all
trusted text; without any trusted text nothing is rejected but texts without
characters; repeated labels count once; extra columns are carried in ``row``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import as_row, col
from docweave.session import reliable_checkpoint

ORDER = 4
BITS = 12
SHARD = 1 << 21
KEPT = 1 << 20  # n-grams that a counting task holds
QUANTILE = 0.99
MARGIN = 1.1
SHRINK = 32
FOLDS = 5
MAX_LANGUAGES = 30_000
MAX_BROADCAST_IDS = 4_000_000
BINS_PER_UNIT = 1000
_CHUNK_CHARS = 1 << 18
_U = np.uint64
_SCORE = T.StructType([T.StructField("n", T.LongType()), T.StructField("logp", T.DoubleType())])


def _grams(texts: list[str], languages: list[int], order: int):
    """``(keys, lengths)``: the n-gram ending at each character (texts are
    padded in front), with the language in the upper bits."""
    pad = "\x02" * (order - 1)
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = points.copy()
    high = np.flatnonzero(points >= 3072)
    classes[high] = 3072 + ((points[high] * np.uint32(0x9E3779B1)) >> np.uint32(22))
    n = len(points) - order + 1
    keys = np.zeros(n, _U)
    for k in range(order):
        keys <<= _U(BITS)
        keys |= classes[k:k + n]
    # a position is a text's own unless its last character is padding
    own = np.ones(n, bool)
    ends = np.cumsum(lengths + order - 1) - (order - 1)
    for k in range(order - 1):
        at = ends[:-1] + k
        own[at] = False
    keys = keys[own]
    keys |= np.repeat(np.array(languages, _U) << _U(BITS * order), lengths)
    return keys, lengths


def _chunks(batch, language_of: dict, text_name="text"):
    """Slices of a batch of about ``_CHUNK_CHARS`` characters; only the texts of one
    are Python strings at a time."""
    column = batch.column(text_name)
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    langs = [language_of.get(x, 0) for x in batch.column("lang").to_pylist()]
    a = held = 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= _CHUNK_CHARS or i + 1 == len(sizes):
            yield a, i + 1, [t or "" for t in column.slice(a, i + 1 - a).to_pylist()], langs[a:i + 1]
            a, held = i + 1, 0


def _count(language_of: dict, pooled: bool, order: int, held_out: bool):
    """n-grams with their uses and trusted counts; with ``held_out`` only texts
    that aren't trusted use theirs."""
    def rows(held):
        keys = np.concatenate([x[0] for x in held])
        order_ = np.argsort(keys, kind="stable")
        keys = keys[order_]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[begin], *(np.add.reduceat(np.concatenate([x[i] for x in held])[order_], begin) for i in (1, 2))

    def batch_of(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])],
                                          names=["gram", "uses", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            flags = batch.column("trusted").to_pylist()
            for a, b, texts, langs in _chunks(batch, language_of):
                for wanted in (True, False):
                    mine = [i for i in range(b - a) if bool(flags[a + i]) == wanted and texts[i]]
                    if not mine:
                        continue
                    keys, _ = _grams([texts[i] for i in mine], [langs[i] for i in mine], order)
                    found, counts = np.unique(keys, return_counts=True)
                    none = np.zeros_like(counts)
                    held.append((found, none if wanted and held_out else counts, counts if wanted else none))
                    size += len(found)
                    if wanted and pooled:  # the model of all languages
                        low = keys & _U((1 << (BITS * order)) - 1)
                        found, counts = np.unique(low, return_counts=True)
                        held.append((found, np.zeros_like(counts), counts))
                        size += len(found)
                if size > KEPT:
                    held = [rows(held)]
                    size = len(held[0][0])
                    if size > KEPT // 2:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(rows(held))
    return run


def _mask(m: int) -> np.uint64:
    return _U((1 << (BITS * m)) - 1)


def _order_counts(grams: np.ndarray, n: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of each order from 2: those of the highest
    are given, lower ones count the distinct n-grams that end with them."""
    out = {order: (grams[n > 0], n[n > 0])}
    for m in range(order - 1, 1, -1):
        out[m] = np.unique(out[m + 1][0] & _mask(m), return_counts=True)
    return out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``values`` of the sorted ``keys`` at ``wanted``, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0.0)


def _shard(table: pa.Table, order: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Language, sorted n-grams, uses and trusted counts of a shard."""
    gram = table.column("gram").to_numpy().view(_U)
    at = np.argsort(gram)
    return (int(gram[0] >> _U(BITS * order)), gram[at] & _mask(order), table.column("uses").to_numpy()[at], table.column("n").to_numpy()[at])


def _shard_statistics(order: int):
    def run(table: pa.Table) -> pa.Table:
        """How many n-grams of each order occur 1 to 4 times (``kind`` is the
        order, ``item`` the number), and for kind 1 in how many bigrams of the
        shard each last character stands."""
        lang, grams, _, n = _shard(table, order)
        counts = _order_counts(grams, n, order)
        rows = [(lang, m, k, int((c == k).sum())) for m, (_, c) in counts.items() for k in (1, 2, 3, 4)]
        last, pairs = np.unique(counts[2][0] & _mask(1), return_counts=True)
        rows += [(lang, 1, int(x), int(y)) for x, y in zip(last, pairs)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["lang", "kind", "item", "value"])

    return run


def _discounts(n: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and more."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
    raw = [0.5 * k if y is None or not n[k] else k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return np.array([0.0] + [min(max(r, 0.05), float(k)) for k, r in zip((1, 2, 3), raw)])


def _level(counts, cut: np.ndarray, wanted: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of ``wanted`` at one order; ``low`` are those
    of the order below."""
    keys, c = counts
    context, where = np.unique(keys >> _U(BITS), return_inverse=True)
    off = np.minimum(cut[np.minimum(c, 3)], c)
    total = np.bincount(where, c, len(context))
    freed = np.bincount(where, off, len(context))
    here = _at(context, total, wanted >> _U(BITS))
    own = _at(keys, c - off, wanted) + _at(context, freed, wanted >> _U(BITS)) * low
    return np.where(here > 0, own / np.where(here > 0, here, 1.0), low)


def _shard_probabilities(order: int, cuts: dict, single: dict):
    def run(table: pa.Table) -> pa.Table:
        lang, grams, uses, n = _shard(table, order)
        counts = _order_counts(grams, n, order)
        keys, p = single.get(lang, (np.zeros(0, _U), np.zeros(0)))
        floor = single.get((lang, None), 1.0 / (1 << BITS))
        below, wanted_below = None, None
        for m in range(2, order + 1):
            wanted = np.unique(grams & _mask(m)) if m < order else grams
            if m == 2:
                known = _at(keys, p, wanted & _mask(1))
                low = np.where(known > 0, known, floor)
            else:
                low = _at(wanted_below, below, wanted & _mask(m - 1))
            below, wanted_below = _level(counts[m], cuts.get((lang, m), np.zeros(4)), wanted, low), wanted
        mine = uses > 0
        gram = grams[mine] | (_U(lang) << _U(BITS * order))
        return pa.table([pa.array(gram.view(np.int64)), pa.array(uses[mine]), pa.array(np.log(below[mine]).astype(np.float32))],
                        names=["gram", "uses", "logp"])

    return run


def gram_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``gram, uses, logp`` of the n-grams that any document holds (``gram,
    uses, n`` with ``n`` the count in trusted text).

    A shard holds the n-grams of a language with the same last character but
    one: every count, continuation count and context sum that its
    probabilities need from order 2 up lies in it. Only the discounts and the
    distribution of single characters are summed over shards."""
    sharded = grams.groupBy(F.shiftrightunsigned("gram", BITS * order).alias("l"),
                            F.shiftrightunsigned("gram", BITS).bitwiseAND(F.lit((1 << BITS) - 1)).alias("c"))
    stats = (sharded.applyInArrow(_shard_statistics(order), "lang long, kind long, item long, value long")
             .groupBy("lang", "kind", "item").agg(F.sum("value").alias("value")).collect())
    by: dict = {}
    for r in stats:
        by.setdefault((r["lang"], r["kind"]), {})[r["item"]] = r["value"]
    cuts = {k: _discounts(v) for k, v in by.items() if k[1] > 1}
    single: dict = {}
    for (lang, kind), v in by.items():
        if kind == 1 and sum(v.values()):
            keys = np.array(sorted(v), _U)
            c = np.array([v[int(k)] for k in keys])
            cut = _discounts({k: int((c == k).sum()) for k in (1, 2, 3, 4)})
            off = np.minimum(cut[np.minimum(c, 3)], c)
            floor = off.sum() / c.sum() / (1 << BITS)
            single[lang] = (keys, (c - off) / c.sum() + floor)
            single[lang, None] = floor
    return sharded.applyInArrow(_shard_probabilities(order, cuts, single), "gram long, uses long, logp float")


class Lookup:
    """Vectorised hash table of n-gram log-probabilities; frequent n-grams
    first, so that nearly all lookups end at the first level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        turn = 0
        while len(keys):
            bits = max(4, int(len(keys) - 1).bit_length())
            factor, shift = _U(pow(0x9E3779B97F4A7C15, 2 * turn + 1, 1 << 64)), _U(64 - bits)
            slot = (keys * factor) >> shift
            owner = np.full(1 << bits, -1, np.int32)
            owner[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # the first key of a slot stays
            taken = np.flatnonzero(owner >= 0)
            first = owner[taken]
            k, v = np.full(1 << bits, ~_U(0)), np.zeros(1 << bits, np.float32)
            k[taken], v[taken] = keys[first], values[first]
            self.levels.append((factor, shift, k, v))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, turn = keys[rest], values[rest], turn + 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        left = None
        for factor, shift, k, v in self.levels:
            wanted = keys if left is None else keys[left]
            slot = (wanted * factor) >> shift
            hit = k[slot] == wanted
            if left is None:
                np.multiply(v[slot], hit, out=out)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = v[slot[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


def _score(sent, language_of: dict, order: int, text_col: str):
    def run(batches):
        find = Lookup(*sent.value)
        for batch in batches:
            row, before = batch.column("row"), batch.column("score")
            sums, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            view = pa.RecordBatch.from_arrays([row.field(text_col), batch.column("lang")], names=["text", "lang"])
            for a, b, texts, langs in _chunks(view, language_of):
                if not any(texts):
                    continue
                keys, lengths = _grams(texts, langs, order)
                ends = np.concatenate(([0], np.cumsum(find(keys), dtype=np.float64)))
                stop = np.cumsum(lengths)
                sums[a:b], sizes[a:b] = ends[stop] - ends[stop - lengths], lengths
            sums += before.field("logp").to_numpy()
            score = pa.StructArray.from_arrays([pa.array(sizes), pa.array(sums)], names=["n", "logp"])
            yield pa.RecordBatch.from_arrays([row, batch.column("lang"), score], names=["row", "lang", "score"])
    return run


class QualityModel:
    """Fitted on ``docs`` and ``labels``: scores documents and holds the
    threshold of each language."""

    def __init__(self, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", label_id: str = "doc_id", trusted: str = "quality = 1", order: int = ORDER,
                 quantile: float = QUANTILE, margin: float = MARGIN, shrink: float = SHRINK,
                 folds: int = 1):
        self.text_col, self.lang_col, self.order, self.shrink = text_col, lang_col, order, float(shrink)
        spark = self.spark = docs.sparkSession
        ids = labels.filter(trusted).select(col(label_id).cast("long").alias("_id")).filter("_id is not null").distinct()
        small = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        ids = (F.broadcast(ids) if small else ids).withColumn("trusted", F.lit(True))
        texts = docs.select(col(id_col).cast("long").alias("_id"), col(lang_col).cast("string").alias("lang"),
                            col(text_col).cast("string").alias("text"))
        joined = texts.join(ids, "_id", "left").select("text", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        all_langs = texts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()
        if len(all_langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        taught = {r["lang"] for r in joined.filter("trusted and length(text) > 0").select("lang").distinct().collect()}
        # 0 is the model of all trusted text
        self.languages = {x: k + 1 for k, x in enumerate(sorted(taught, key=lambda x: (x is not None, x or "")))}
        pooled = any(r["lang"] not in taught for r in all_langs)
        self.sent = self._fit(joined, self.languages, pooled)
        self.shards = len(self.sent)
        only = docs.withColumn("_id", col(id_col).cast("long")).join(ids, "_id", "left_semi").select(*[col(c) for c in {text_col, lang_col}])
        self._fit_thresholds(self.scored(only) if folds < 2 else self._held_out(only, folds), quantile, margin)

    def _fit(self, texts: DataFrame, languages: dict, pooled: bool, held_out: bool = False) -> list:
        """Broadcast lookup tables of a model of the trusted ones of ``texts``."""
        counted = texts.select("text", "lang", "trusted").mapInArrow(
            _count(languages, pooled, self.order, held_out), "gram long, uses long, n long")
        grams = reliable_checkpoint(counted.groupBy("gram").agg(F.sum("uses").alias("uses"), F.sum("n").alias("n")))
        table = reliable_checkpoint(gram_probabilities(grams, self.order))
        shards, sent = max(1, math.ceil(table.count() / SHARD)), []
        for s in range(shards):
            part = table.filter(F.pmod(F.xxhash64("gram"), F.lit(shards)) == s).toArrow()
            gram, uses, logp = (part.column(c).to_numpy() for c in ("gram", "uses", "logp"))
            at = np.lexsort((gram, -uses))
            sent.append(self.spark.sparkContext.broadcast((gram[at].view(_U), logp[at])))
        return sent

    def _held_out(self, only: DataFrame, folds: int) -> DataFrame:
        """``scored`` of the trusted rows, each fold by a model of the others."""
        text = col(self.text_col).cast("string")
        dealt = only.withColumn("_fold", F.pmod(F.xxhash64(text), F.lit(folds))).filter(F.length(text) > 0)
        places = {(r["lang"], r["fold"]) for r in dealt.select(
            col(self.lang_col).cast("string").alias("lang"), F.col("_fold").alias("fold")).distinct().collect()}
        out = None
        for fold in sorted({k for _, k in places}):
            others = {x for x, k in places if k != fold}
            languages = {x: k for x, k in self.languages.items() if x in others}
            pooled = any(k == fold and x not in others for x, k in places)
            texts = dealt.select(text.alias("text"), col(self.lang_col).cast("string").alias("lang"),
                                 (F.col("_fold") != fold).alias("trusted"))
            sent = self._fit(texts, languages, pooled, held_out=True)
            part = reliable_checkpoint(self._scored(dealt.filter(F.col("_fold") == fold).drop("_fold"), sent, languages)
                                       .select("lang", "score"))
            for b in sent:
                b.destroy()
            out = part if out is None else out.union(part)
        return self.scored(only) if out is None else out

    def scored(self, docs: DataFrame) -> DataFrame:
        """``(row, lang, score)`` with the number of characters and the sum of
        their log-probabilities."""
        return self._scored(docs, self.sent, self.languages)

    def _scored(self, docs: DataFrame, tables: list, languages: dict) -> DataFrame:
        packed = as_row(docs).select("row", F.col("row")[self.lang_col].cast("string").alias("lang"),
                                     F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("logp")).alias("score"))
        schema = T.StructType([packed.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", _SCORE)])
        for sent in tables:
            packed = packed.mapInArrow(_score(sent, languages, self.order, self.text_col), schema)
        return packed

    def _by_language(self, values: dict):
        """A column with the value of the row's language, else that of key 0."""
        out = F.lit(values.get(0))
        for lang, value in values.items():
            if lang != 0:
                out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(out)
        return out

    def _log_perplexity(self):
        """Per character, with ``shrink`` characters of the language's mean."""
        n = F.col("score.n")
        return F.when(n > 0, (self._by_language(self.means) * self.shrink - F.col("score.logp")) / (n + self.shrink))

    def _fit_thresholds(self, scored: DataFrame, quantile: float, margin: float) -> None:
        """Means and quantiles of log-perplexity per language, the quantile to
        a bin of 1 / BINS_PER_UNIT, times ``margin``; key 0 holds that of all."""
        scored = reliable_checkpoint(scored.select("lang", "score").filter("score.n > 0"))
        sums = {r["lang"]: (r["logp"], r["n"]) for r in scored.groupBy("lang").agg(
            F.sum("score.logp").alias("logp"), F.sum("score.n").alias("n")).collect()}
        if not sums:
            self.means, self.thresholds = {0: 0.0}, {0: math.inf}
            return
        sums[0] = tuple(map(sum, zip(*sums.values())))
        self.means = {k: -logp / n for k, (logp, n) in sums.items()}
        bins = (scored.groupBy("lang", F.ceil(self._log_perplexity() * BINS_PER_UNIT).cast("long").alias("bin"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        self.thresholds = {}
        for key in sums:
            mine = sorted((r["bin"], r["n"]) for r in bins if key == 0 or r["lang"] == key)
            need, seen = quantile * sum(n for _, n in mine), 0
            for b, n in mine:
                seen += n
                if seen >= need:
                    self.thresholds[key] = math.exp(b / BINS_PER_UNIT) * margin
                    break

    def classify(self, docs: DataFrame) -> DataFrame:
        """``(row, perplexity, threshold, rejected)``."""
        out = self.scored(docs).select("row", F.exp(self._log_perplexity()).alias("perplexity"),
                                       self._by_language(self.thresholds).alias("threshold"))
        return out.withColumn("rejected", F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(True)))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all columns;
    thresholds from held-out perplexity."""
    return QualityModel(docs, labels, **{"folds": FOLDS, **options}).classify(docs).filter("not rejected").select("row.*")
