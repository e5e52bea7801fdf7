"""SentencePiece models on the tokenizers library.

``read_model`` parses the model protobuf (wire format, no generated classes);
``build_tokenizer`` rebuilds from it the normaliser (compiled character map,
blank squeezing, dummy prefix), the metaspace marker, the unigram scores or the
merge order of a BPE model, and byte fallback. Batches are encoded and decoded
by the library's thread pool inside Spark tasks; the model travels as its bytes
(a fixed file of under a few MB).

Defined cases: null text encodes to null and decodes to null, empty text to an
empty list; control symbols in a text are ordinary text; texts of any length
are encoded whole; extra columns are carried untouched.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import as_row, col

MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
BATCH_BYTES = 1 << 20
KEPT_WORDS = 1 << 20
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# fixed values: numbers of the published sentencepiece_model.proto
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """``(number, value)`` of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at:at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def read_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a piece, best resulting piece first."""
    rank = {p: (-s, i) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER_DEFINED)}
    found = [(rank[p], rank[p[:c]], rank[p[c:]], p[:c], p[c:])
             for p in rank for c in range(1, len(p)) if p[:c] in rank and p[c:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


def _words_apart(model: Model) -> bool:
    """Whether no piece goes on with a metaspace after another character, so
    that words can be encoded one by one with the same result."""
    return not any(MARK in p.lstrip(MARK) for p, _, k in model.pieces if k in (NORMAL, USER_DEFINED))


def _core(model: Model):
    from tokenizers import models

    if model.model_type == BPE:
        return models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_merges(model),
                          unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    if model.model_type == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    raise ValueError(f"model type {model.model_type} has no counterpart")


def build_tokenizer(model: Model):
    """A tokenizer with the model's normaliser, pieces and decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers

    tok = Tokenizer(_core(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    own = [p for p, _, k in model.pieces if k == USER_DEFINED]
    if own:
        tok.add_tokens([AddedToken(p, normalized=True) for p in own])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []))
    return tok


class Codec:
    """Encodes and decodes batches. Where no piece spans two words, each
    distinct word is encoded once and kept (up to ``KEPT_WORDS``)."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.model = read_model(data)
        self.tok = build_tokenizer(self.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra_whitespaces
        apart = self.model.escape_whitespaces and _words_apart(self.model) and not any(
            k == USER_DEFINED for _, _, k in self.model.pieces)
        self.by_word = Tokenizer(_core(self.model)) if apart else None
        self.kept: dict[str, bytes] = {}
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode("utf-8")
                            for p, _, k in self.model.pieces]

    def _words(self, text: str) -> list[str]:
        if not self.plain:
            text = self.tok.normalizer.normalize_str(text)
        elif text:
            text = (MARK if self.model.add_dummy_prefix else "") + text.replace(" ", MARK)
        return _WORD.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_word is None:
            return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        words = [self._words(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = list(set(chain.from_iterable(words)).difference(self.kept))
        for w, e in zip(new, self.by_word.encode_batch_fast(new, add_special_tokens=False)):
            self.kept[w] = np.array(e.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, ws)), np.int32) for ws in words]

    def decode(self, ids: list) -> list[str]:
        """Joins the bytes of the pieces; what isn't UTF-8 so is left to the
        library's decoder."""
        out = []
        for x in ids:
            x = x.tolist() if isinstance(x, np.ndarray) else x
            try:
                text = b"".join(map(self.piece_bytes.__getitem__, x)).decode("utf-8")
            except UnicodeDecodeError:
                text = self.tok.decode(x, skip_special_tokens=False)
            else:
                text = text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text
            out.append(text)
        return out


def _id_lists(ids: list, null: list[bool]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(i) for i in ids], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array(null, pa.bool_()))


_BUILT: dict[int, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    """One codec per worker process."""
    key = hash(data)
    if key not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        _BUILT[key] = Codec(data)
    return _BUILT[key]


def load_model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return data


def _slices(sizes: list[int]):
    """Index ranges of at most ``BATCH_BYTES`` (one text at least)."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, model_bytes: bytes, *, text_col: str = "text", threads: int = 2) -> DataFrame:
    """``(row, ids)``: the columns of ``df`` and the token ids of its text."""
    packed = as_row(df)
    sent = df.sparkSession.sparkContext.broadcast(model_bytes)
    schema = T.StructType([packed.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = _codec(sent.value, threads)
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text_col).to_pylist()
            sizes = [len(t or "") for t in texts]
            for a, b in _slices(sizes):
                ids = _id_lists(codec.encode([t or "" for t in texts[a:b]]), [t is None for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), ids], names=["row", "ids"])

    return packed.mapInArrow(run, schema)


def decode(df: DataFrame, model_bytes: bytes, *, ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """The columns of ``df`` and ``decoded``, the text of ``ids_col``."""
    sent = df.sparkSession.sparkContext.broadcast(model_bytes)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    names = schema.names

    def run(batches):
        codec = _codec(sent.value, threads)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            for a, b in _slices([4 * len(x or []) for x in ids]):
                got = codec.decode([x or [] for x in ids[a:b]])
                texts = pa.array([None if x is None else t for x, t in zip(ids[a:b], got)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, texts], names=names)

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, model_bytes: bytes, *, text_col: str = "text", threads: int = 2) -> DataFrame:
    """``(row, ids, exact)``: ``exact`` tells whether the ids decode to the
    very text (false only where the model's normaliser changes it)."""
    packed = as_row(df)
    sent = df.sparkSession.sparkContext.broadcast(model_bytes)
    schema = T.StructType([packed.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("exact", T.BooleanType())])

    def run(batches):
        codec = _codec(sent.value, threads)
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text_col).to_pylist()
            for a, b in _slices([len(t or "") for t in texts]):
                part = [t or "" for t in texts[a:b]]
                ids = codec.encode(part)
                back = codec.decode(ids)
                null = [t is None for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [row.slice(a, b - a),
                     _id_lists(ids, null),
                     pa.array([None if z else t == s for z, t, s in zip(null, part, back)], pa.bool_())],
                    names=["row", "ids", "exact"])

    return packed.mapInArrow(run, schema)


def ids_digest(ids="ids"):
    """SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
