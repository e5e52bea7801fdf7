"""Alignment of two tokenisations of one text by diagonal run skipping.

A byte-level BPE (A) and a SentencePiece model (B) cut the same bytes at
different places. Both lists of end offsets grow strictly and end alike, so an
index shift ``j - i`` belongs to each stretch of tokens that agree one to one.
``align`` probes exponentially growing slices of both lists at the current
shift, jumps what agrees, resolves the irregular group that follows by walking
to the next common end, and goes on with the new shift.

Every pair of tokens whose byte ranges overlap is a link. How often the corpus
links a pair of ids is counted from the distinct pairs of blocks of texts
(pre-aggregated per block), the counts return to the blocks that asked for
them, and each document sums its own. No table of pairs is ever broadcast or
collected; a pair of ids comes from each block once, so a frequent pair is no
hot key, and joins on it may be split.

Defined cases: a text that is null or empty, or whose tokens' bytes on either
side aren't a blank and the text, has no tokens: zeros and an empty digest.
Repeated rows and null ids are rows like any other. Extra columns are carried
in ``row``. An empty table gives an empty table. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import as_row
from docweave.llm.sentencepiece_codec import USER_DEFINED, read_model
from docweave.session import scratch_dir

MARK = "▁"
MAX_FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
KEPT_WORDS = 3 << 19
SLICE_LETTERS = 1 << 16
_BLANK = re.compile(r"(?<=\S) (?=\S)")
ID_BITS = 32


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Groups between common ends of strictly growing end offsets whose last
    ones are equal: stretches ``(i, j, k)`` of ``k`` groups, the first of which
    ends with token ``i`` of A and ``j`` of B; those after it are one to one."""
    n, i, shift = len(a), 0, 0
    stretches = []
    while i < n:
        j = i + shift
        x, y = a[i], b[j]
        while x != y:  # an irregular group: walk to its end, take the new shift
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        shift = j - i
        at, width = i + 1, 1
        while width:  # slices double while they agree, halve after the first that doesn't
            part = a[at:at + width]
            if part and part == b[at + shift:at + shift + width]:
                at += width
                width *= 2
            else:
                width //= 2
        at = min(at, n)
        stretches.append((i, j, at - i))
        i = at
    return stretches


def group_ends(stretches: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and of B tokens up to the end of each group."""
    i, j, k = np.array(stretches, np.int64).reshape(-1, 3).T
    within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(i, k) + within + 1, np.repeat(j, k) + within + 1


def _byte_level() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Token ids by one tokenizer and the bytes of each id. ``apart`` tells
    that a text may be cut before a single blank between two other characters
    without a change of its tokens."""

    def __init__(self, entries: list[bytes], apart: bool):
        self.entries, self.apart = entries, apart
        self.lengths = np.array([len(e) for e in entries], np.int64)

    def whole(self, ids: list[int], text: str) -> bool:
        """Whether the tokens' bytes are a blank and the text."""
        return b"".join(map(self.entries.__getitem__, ids)) == (" " + text).encode()


class ByteLevel(Tokens):
    """Tokenizers-library file of a byte-level BPE."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        to_byte = _byte_level()
        known = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        entries = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            entries[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        # its pattern of words takes a blank to the word after it
        cut = spec.get("pre_tokenizer") or {}
        super().__init__(entries, cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not spec.get("normalizer"))
        self.tok = Tokenizer.from_str(data.decode())
        self.tok.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Tokens):
    """SentencePiece model file; the model itself adds the blank."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_proto=data)
        entries, apart = [], True
        for i in range(self.tok.get_piece_size()):
            piece = self.tok.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.tok.is_byte(i) else piece.replace(MARK, " ").encode())
            apart &= MARK not in piece.lstrip(MARK)
        spec = read_model(data)
        plain = not spec.charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        super().__init__(entries, apart and plain and not any(k == USER_DEFINED for *_, k in spec.pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tok.encode(texts, num_threads=1)


class Kept:
    """Ids of numbered words, found again for any list of word numbers."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, order: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Words ``order`` (all new ones, in any order) and their ids."""
        size = np.concatenate(sizes)
        start = len(self.ids) + np.cumsum(size) - size
        place = np.argsort(order)
        self.ids = np.concatenate([self.ids, *ids])
        self.starts = np.concatenate([self.starts, start[place]])
        self.sizes = np.concatenate([self.sizes, size[place]])

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word ends."""
        size = self.sizes[words]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.starts[words] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Both:
    """Ids of texts by both tokenizers. Where both allow it, texts are cut at
    single blanks, and each distinct word is encoded once and kept (up to
    ``KEPT_WORDS`` of them); new words are encoded many at a time, joined by
    blanks as in a text."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_bpe), Pieces(pieces)
        self.cut = self.a.apart and self.b.apart
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.kept, self.odd = (Kept(), Kept()), np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, given in the order of their numbers."""
        joint = [k for k, w in enumerate(words) if self.cut and w and not w[-1].isspace()]
        alone = sorted(set(range(len(words))).difference(joint))
        todo, size, start = [[k] for k in alone], 0, 0
        for at, k in enumerate(joint):
            size += len(words[k]) + 1
            if size >= SLICE_LETTERS or at == len(joint) - 1:
                todo.append(joint[start:at + 1])
                size, start = 0, at + 1
        order, found, odd = [], ([], [], [], []), []
        while todo:
            part = todo.pop()
            text = " ".join(words[k] for k in part)
            ends = np.cumsum([len(words[k].encode()) + 1 for k in part])
            got = [self._cut(side, text, ends) for side in (self.a, self.b)]
            if None in got and len(part) > 1:  # a word in it is odd: halve
                todo += [part[:len(part) // 2], part[len(part) // 2:]]
                continue
            order += part
            odd += [None in got] * len(part)
            for k, x in enumerate(got):
                found[2 * k].append(np.zeros(0, np.int32) if x is None else x[0])
                found[2 * k + 1].append(np.zeros(1, np.int64) if x is None else x[1])
        place = np.array(order, np.int64)
        for k, kept in enumerate(self.kept):
            kept.add(place, found[2 * k], found[2 * k + 1])
        self.odd = np.concatenate([self.odd, np.array(odd, bool)[np.argsort(place)]])

    @staticmethod
    def _cut(side: Tokens, text: str, ends: np.ndarray):
        """Ids of the text and how many belong to each word; None where the
        tokens' bytes aren't a blank and the text, or don't end with words."""
        ids = side.encode([text])[0]
        if not side.whole(ids, text):
            return None
        ids = np.array(ids, np.int32)
        at = np.cumsum(side.lengths[ids])
        upto = np.searchsorted(at, ends)
        return (ids, np.diff(upto, prepend=-1)) if (at[upto] == ends).all() else None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """None: no tokens."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        words = [_BLANK.split(" " + t) if self.cut and t else [" " + t] for t in texts]
        for w in words:
            w[0] = w[0][1:]
        ends = np.cumsum([len(w) for w in words])
        known = len(self.number)
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]) if len(ends) else 0)
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        bad = np.concatenate([[0], np.cumsum(self.odd[which])])[np.concatenate([[0], ends])]
        sides = []
        for kept in self.kept:
            ids, upto = kept.take(which)
            sides.append(np.split(ids, upto[ends - 1])[:-1])
        return [None if not t or z else pair for t, z, pair in zip(texts, np.diff(bad), zip(*sides))]


_BUILT: dict[int, Both] = {}


def _tokenizers(byte_bpe: bytes, pieces: bytes) -> Both:
    """One pair per worker process."""
    key = hash((byte_bpe, pieces))
    if key not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _BUILT[key] = Both(byte_bpe, pieces)
    return _BUILT[key]


def read_file(path: str) -> bytes:
    """A tokenizer file: a fixed file of a few MB, its size checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return data


def links(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """A code ``a << 32 | b`` for each overlap of an A with a B token: one for
    each stretch between neighbouring ends of either side."""
    marks = np.zeros((2, int(ends_a[-1]) + 1), np.int32)
    marks[0, ends_a] = marks[1, ends_b] = 1
    ends = np.flatnonzero(marks[0] | marks[1])
    before = np.cumsum(marks, axis=1, dtype=np.int32)
    return ids_a[before[0, ends - 1]].astype(np.int64) << ID_BITS | ids_b[before[1, ends - 1]]


def _spelled(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids below ``size``, left-aligned, and how many."""
    width = len(str(max(size - 1, 1)))
    text = np.arange(size).astype(f"S{width}")
    digits = np.zeros((size, width + 1), np.uint8)
    digits[:, :width] = text.view(np.uint8).reshape(size, width)
    return digits, (digits != 0).sum(axis=1)


_DIGITS: list = []


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of A and of B by group, in order."""
    top = int(max(ids_a.max(), ids_b.max())) + 1
    if not _DIGITS or len(_DIGITS[0]) < top:
        _DIGITS[:] = _spelled(max(top, 1 << 16))
    digits, width = _DIGITS
    n_a, n_b = len(ids_a), len(ids_b)
    per_a, per_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    ids, after = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[np.arange(n_a) + np.repeat(cut_b - per_b, per_a)] = ids_a
    ids[np.arange(n_b) + np.repeat(cut_a, per_b)] = ids_b
    after[cut_a - 1 + cut_b - per_b] = ord("|")
    after[cut_b - 1 + cut_a] = ord(";")
    chars = digits[ids]
    chars[np.arange(len(ids)), width[ids]] = after
    return chars[chars != 0].tobytes()[:-1]


_STATS = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()),
          ("groups_sha256", T.StringType())]
_NO_TOKENS = (0, 0, 0, 0, "")
_NO_CODES = np.zeros(0, np.int64)


def _aligned(texts: list[str | None], both: Both) -> tuple[list[tuple], list[np.ndarray]]:
    """Per text the values of ``_STATS`` and its link codes."""
    stats, codes = [], []
    for found in both.encode([t or "" for t in texts]):
        if found is None:
            stats.append(_NO_TOKENS)
            codes.append(_NO_CODES)
            continue
        x, y = found
        ends_a, ends_b = np.cumsum(both.a.lengths[x]), np.cumsum(both.b.lengths[y])
        cut_a, cut_b = group_ends(align(ends_a.tolist(), ends_b.tolist()))
        codes.append(links(x, y, ends_a, ends_b))
        digest = hashlib.sha256(group_text(x, y, cut_a, cut_b)).hexdigest()
        stats.append((len(x), len(y), len(cut_a), len(codes[-1]), digest))
    return stats, codes


def _block(rows: list[pa.Array], stats: list[tuple], codes: list[np.ndarray], name: str) -> pa.RecordBatch:
    """One row: the documents of a block with their links as sorted positions
    in the block's list of distinct pairs, stored as differences."""
    sizes = np.array([len(c) for c in codes], np.int64)
    every = np.concatenate(codes)
    pairs = np.unique(every)
    where = np.searchsorted(pairs, every)
    times = np.bincount(where, minlength=len(pairs))
    own = np.repeat(np.arange(len(codes)), sizes) * max(len(pairs), 1) + where
    own, how_often = np.unique(own, return_counts=True)
    owner, where = np.divmod(own, max(len(pairs), 1))
    step = np.diff(where, prepend=0)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    step[starts] = where[starts]
    held = np.bincount(owner, minlength=len(codes)) if len(owner) else np.zeros(len(codes), np.int64)
    row = pa.concat_arrays(rows)
    docs = pa.StructArray.from_arrays(
        [row, *[pa.array([s[k] for s in stats]) for k in range(len(_STATS))], pa.array(held, pa.int64())],
        names=["row", *[n for n, _ in _STATS], "n_held"])
    as_list = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), as_list(docs), as_list(pa.array(pairs)), as_list(pa.array(times, pa.int64())),
         pa.array([step.astype(np.int32).tobytes()], pa.binary()), pa.array([how_often.astype(np.int32).tobytes()], pa.binary())],
        names=["block", "docs", "pairs", "times", "steps", "how_often"])


def align_blocks(df: DataFrame, byte_bpe: bytes, pieces: bytes, *, text_col: str = "text") -> DataFrame:
    """Blocks of about ``BLOCK_BYTES`` of text, one row each: the documents
    with counts and digest, the block's distinct pairs, and each document's
    links as positions among them. The text itself goes no further: of
    ``row`` all other columns stay."""
    packed = as_row(df)
    kept = [f for f in packed.schema["row"].dataType.fields if f.name != text_col]
    doc = T.StructType([T.StructField("row", T.StructType(kept)), *[T.StructField(n, t) for n, t in _STATS],
                        T.StructField("n_held", T.LongType())])
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("docs", T.ArrayType(doc)),
                           T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
                           T.StructField("steps", T.BinaryType()), T.StructField("how_often", T.BinaryType())])
    sent = df.sparkSession.sparkContext.broadcast((byte_bpe, pieces))

    def run(batches):
        both = _tokenizers(*sent.value)
        task = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        rows, stats, codes, held, made = [], [], [], 0, 0
        for batch in batches:
            row = batch.column("row")
            rest = pa.StructArray.from_arrays([row.field(f.name) for f in kept], names=[f.name for f in kept]) if kept else row
            texts = row.field(text_col)
            start = 0
            while start < len(texts):
                end = start
                while end < len(texts) and held < BLOCK_BYTES:
                    held += len(texts[end].as_py() or "") + 64
                    end += 1
                got = _aligned(texts.slice(start, end - start).to_pylist(), both)
                rows.append(rest.slice(start, end - start))
                stats += got[0]
                codes += got[1]
                if held >= BLOCK_BYTES:
                    yield _block(rows, stats, codes, f"{task}-{made}")
                    rows, stats, codes, held, made = [], [], [], 0, made + 1
                start = end
        if stats:
            yield _block(rows, stats, codes, f"{task}-{made}")

    return packed.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)`` over all blocks: how many links hold the pair,
    and whether that is the most of its B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most.hint("merge"), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_statistics(df: DataFrame, byte_bpe: bytes, pieces: bytes, *, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` but the text in ``row``, and ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spark = df.sparkSession
    path = scratch_dir(spark, "alignment")
    align_blocks(df, byte_bpe, pieces, text_col=text_col).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(pair_counts(blocks).hint("merge"), "pair").select("asker", "at", "count", "best")
    main = blocks.select("block", "docs", "steps", "how_often")
    doc = main.schema["docs"].dataType.elementType
    out = T.StructType([doc["row"], *[T.StructField(n, t) for n, t in _STATS],
                        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        # one block: a bounded number of bytes on the left, its pairs on the right
        order = np.argsort(right.column("at").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = np.where(right.column("best").to_numpy(zero_copy_only=False)[order], 1, 0)
        made = []
        for k in range(left.num_rows):
            docs = left.column("docs")[k].values
            step = np.frombuffer(left.column("steps")[k].as_py(), np.int32).astype(np.int64)
            times = np.frombuffer(left.column("how_often")[k].as_py(), np.int32).astype(np.int64)
            held = docs.field("n_held").to_numpy()
            ends = np.cumsum(held)
            where = _undone(step, held, ends)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])  # noqa: E731,B023
            made.append(pa.Table.from_arrays(
                [docs.field("row"), *[docs.field(n) for n, _ in _STATS],
                 pa.array(total(best[where] * times) if len(where) else np.zeros(len(held), np.int64)),
                 pa.array(total(count[where] * times) if len(where) else np.zeros(len(held), np.int64))], names=out.names))
        return pa.concat_tables(made) if made else pa.Table.from_pylist([], pa.schema([(n, pa.null()) for n in out.names]))

    return main.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(finish, out)


def _undone(step: np.ndarray, held: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions from the differences that ``_block`` stores per document."""
    run = np.cumsum(step)
    starts = (ends - held)[held > 0]
    base = np.zeros(len(step), np.int64)
    before = np.concatenate([[0], run])[starts]
    base[starts] = np.diff(before, prepend=0)
    return run - np.cumsum(base)
