"""Repeated windows of texts, exactly and without a row per position.

Both substring operators ask which runs of ``window`` tokens occur elsewhere.
The work is cut into blocks of a few MB of text, dealt out once by a hash; the
same shuffle files feed four passes:

1. *Anchors.* In each window the seed (a run of ``seed`` tokens) with the
   smallest hash is its anchor, so equal windows have equal anchors at equal
   offsets, and consecutive windows share one. A block sends the distinct hashes
   of its anchors to buckets (ranges of the hash), which answer one bit each:
   whether the anchor occurs elsewhere.
2. *Contexts.* For anchors that do, the block sends a hash of the whole stretch
   that the anchor's windows cover. Equal stretches settle all their windows at
   once; the bucket also tells which anchors have several contexts.
3. *Windows.* Only where an anchor branches, one occurrence of each context
   sends its single windows.
4. The answers are put together and the covered tokens marked.

A hot text or passage costs one entry per block, not one per document; no group
holds more than one entry of a block for a key; stretches and windows are
compared by hashes (48 bits of the anchor and 48 of their own, both from the
same tokens), never as text. Messages are packed arrays, so the
shuffles carry about six bytes for an anchor.

Two rules: ``anywhere`` (a window is repeated when its sequence starts at any
other place) and ``earlier`` (when it also starts in a document with a smaller
id).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import col, shuffle_partitions, text_buffers

BLOCK_BYTES = 2 << 20
BLOCKS_PER_BUCKET = 4
CHUNK = 1 << 15
_U = np.uint64
_POS_BITS = 20
_POS = _U((1 << _POS_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 5
_PLACES = np.arange(1 << _POS_BITS, dtype=_U)
_LAST_ID = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes ``h``."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * CHUNK, 1 << int(n).bit_length())
    return _powers(size, False)[:n], _powers(size, True)[:n]


def prefix_hashes(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens) + 1, _U)
    np.cumsum(tokens * _tables(len(tokens))[0], out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (prefix[stop] - prefix[start]) * _tables(len(prefix))[1][start]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def byte_tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token values of concatenated texts, and the token end of each text."""
    return _BYTE_VALUES[data], ends


def word_tokens(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same for words ``[^\\x20\\x09-\\x0D]+``; ``lower`` folds A-Z. A word
    is hashed eight bytes at a time, each piece mixed with its place: sums of
    powers collide on words that differ by a regular pattern."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[ends] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | cut))
    stops = np.flatnonzero(before & (~after | cut))
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(16, np.uint8))).tobytes(), strides=(1,))
    out = np.empty(len(starts), _U)
    pieces = (stops - starts + 7) >> 3
    upto = np.cumsum(pieces)
    first = done = 0
    while first < len(starts):  # whole words, as many as keep the arrays small
        last = max(first + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        n = pieces[first:last]
        place = np.arange(upto[last - 1] - done) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[first:last], n) + 8 * place
        unused = np.maximum(at + 8 - np.repeat(stops[first:last], n), 0).astype(_U) * _U(8)
        part = mix((eight[at] << unused >> unused) + mix((place + 1).astype(_U) * _U(_BASE)))
        out[first:last] = mix(np.add.reduceat(part, np.cumsum(n) - n) + (stops - starts)[first:last].astype(_U))
        first, done = last, upto[last - 1]
    return out, np.searchsorted(starts, ends)


@dataclass
class Found:
    """Anchors of a block: each with the first and last of its windows."""

    key: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    piece: np.ndarray
    pieces: list  # (token offset, prefix hashes)
    window: int

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index into which, window start, hash)`` of each window of the
        anchors ``which``."""
        n = (self.last[which] - self.first[which] + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(which)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[which], n)
        out = np.empty(len(start), _U)
        piece = self.piece[which][owner]
        for p in np.unique(piece):
            sel = np.flatnonzero(piece == p)
            offset, prefix = self.pieces[p]
            s = start[sel] - offset
            out[sel] = mix(run_hashes(prefix, s, s + self.window))
        return owner, start, out


def find_anchors(tokens: np.ndarray, ends: np.ndarray, window: int, seed: int) -> Found:
    """Anchors of concatenated texts (``ends``: token end of each)."""
    span = window - seed + 1
    parts, pieces = [], []
    doc_start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    at = 0
    while at + window <= len(tokens):
        to = min(len(tokens), at + CHUNK)
        tok = tokens[at:to]
        n = len(tok)
        prefix = prefix_hashes(tok)
        inverse = _tables(n + 1)[1]
        seeds = prefix[seed:] - prefix[:-seed]
        seeds *= inverse[:n - seed + 1]
        spare = seeds >> _U(32)
        seeds ^= spare
        seeds *= _U(0xD6E8FEB86659FD93)
        low = np.bitwise_and(seeds, ~_POS, out=spare)
        low |= _PLACES[:len(seeds)]
        have = 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:], out=low[:-have])
            have *= 2
        if have < span:
            low = np.minimum(low[:len(low) - (span - have)], low[span - have:], out=low[:len(low) - (span - have)])
        # starts of windows that end within their text
        inner = ends[np.searchsorted(ends, at, "right"):np.searchsorted(ends, to, "right")] - at
        barred = np.zeros(n + 1, np.int32)
        np.add.at(barred, np.maximum(inner - window + 1, 0), 1)
        np.add.at(barred, inner, -1)
        starts = np.flatnonzero(np.cumsum(barred[:len(low)]) == 0)
        if len(starts):
            place = (low[starts] & _POS).astype(np.int64)
            turn = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            first, last, anchor = starts[turn], starts[np.concatenate((turn[1:], [len(starts)])) - 1], place[turn]
            whole = run_hashes(prefix, first, last + window)
            whole += (anchor - first).astype(_U) * _U(0x8CB92BA72F3D8DD7) + (last - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F)
            # anchors are small hashes; mixed again, they fill the buckets evenly
            parts.append((mix(seeds[anchor]) >> _U(16), mix(whole), first + at, last + at, np.full(len(turn), len(pieces))))
        pieces.append((at, prefix))
        if to == len(tokens):
            break
        at = to - window + 1
    empty = np.zeros(0, np.int64)
    key, context, first, last, piece = map(np.concatenate, zip(*parts)) if parts else (
        empty.astype(_U), empty.astype(_U), empty, empty, empty)
    doc = np.searchsorted(doc_start, first, "right") - 1
    # texts without tokens share their start with the next one
    return Found(key, context, doc, first, last, piece, pieces, window)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 48-bit keys."""
    bounds = np.array([-(-(b << 48) // buckets) for b in range(buckets + 1)], np.uint64)
    return np.searchsorted(keys, bounds)


def _groups(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order by ``cols``, where groups begin in it, and the group of
    each row."""
    order = np.lexsort(cols[::-1]) if len(cols) > 1 else np.argsort(cols[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _reduce(ufunc, values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return ufunc.reduceat(values[order], begin) if len(begin) else values[:0]


class Rule:
    """Which windows count as repeated, as seen from one block and from a
    bucket. ``value`` of an entry: with ``anywhere`` the number of occurrences
    (2 stands for more), with ``earlier`` the smallest id."""

    def __init__(self, earlier: bool):
        self.earlier = earlier
        self.join = np.minimum if earlier else np.add

    def of(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.earlier else np.ones(len(ids), np.int64)

    def merge(self, values, order, begin):
        out = _reduce(self.join, values, order, begin)
        return out if self.earlier else np.minimum(out, 2)

    def settled(self, whole: np.ndarray, own: np.ndarray) -> np.ndarray:
        return whole < own if self.earlier else whole >= 2


class Block:
    """What a block knows, from its texts and the answers so far."""

    def __init__(self, found: Found, ids: np.ndarray, rule: Rule, answers: dict[int, np.ndarray]):
        self.found, self.ids, self.rule = found, ids[found.doc], rule
        self.order, self.begin, self.group = _groups(found.key)
        self.keys = found.key[self.order][self.begin]
        if 1 in answers:
            self._contexts(answers[1].astype(bool))
        if 2 in answers:
            self._windows(answers[2])

    def anchors(self):
        low, high = (_reduce(f, self.ids if self.rule.earlier else np.arange(len(self.ids)), self.order, self.begin)
                     for f in (np.minimum, np.maximum))
        return self.keys, {"value": (low != high).astype(np.int64)}

    def _contexts(self, elsewhere: np.ndarray) -> None:
        """Distinct (anchor, context) of the anchors that occur elsewhere."""
        self.at = np.flatnonzero(elsewhere[self.group])
        key, context = self.found.key[self.at], self.found.context[self.at]
        order, begin, self.ctx = _groups(key, context)
        self.ctx_one = self.at[order][begin]
        self.ctx_key, self.ctx_hash = key[order][begin], context[order][begin]
        self.ctx_value = self.rule.merge(self.rule.of(self.ids[self.at]), order, begin)

    def contexts(self):
        return self.ctx_key, {"hash": self.ctx_hash, "value": self.ctx_value}

    def _windows(self, flags: np.ndarray) -> None:
        self.settled, branching, speaks = (flags & 1).astype(bool), (flags & 2).astype(bool), (flags & 4).astype(bool)
        self.open = branching & ~self.settled
        self.ask = np.flatnonzero(branching & (speaks if not self.rule.earlier else ~self.settled))
        owner, start, h = self.found.window_hashes(self.ctx_one[self.ask])
        key = self.ctx_key[self.ask][owner]
        weight = self.ctx_value if self.rule.earlier else np.where(self.settled, 2, self.ctx_value)
        # dealt by the window's own hash: an anchor may have many windows
        key, h = h >> _U(16), key << _U(16)
        order, begin, self.win = _groups(key, h)
        self.win_owner = owner
        self.win_offset = start - self.found.first[self.ctx_one[self.ask]][owner]
        self.win_key, self.win_hash = key[order][begin], h[order][begin]
        self.win_value = self.rule.merge(weight[self.ask][owner], order, begin)

    def windows(self):
        return self.win_key, {"hash": self.win_hash, "value": self.win_value}

    def covered(self, size: int, flags: np.ndarray) -> np.ndarray:
        """Mask of the tokens that repeated windows cover."""
        change = np.zeros(size + 1, np.int32)
        one = self.rule.earlier
        own = self.ids[self.at]
        # all windows of an occurrence
        done = self.settled[self.ctx] | (own > self.ctx_value[self.ctx] if one else False)
        full = self.at[done]
        np.add.at(change, self.found.first[full], 1)
        np.add.at(change, self.found.last[full] + self.found.window, -1)
        # single windows of the others
        rest = np.flatnonzero(~done & self.open[self.ctx])
        if len(rest) and len(self.ask):
            asked = np.full(len(self.ctx_key), -1)
            asked[self.ask] = np.arange(len(self.ask))
            begin = np.searchsorted(self.win_owner, np.arange(len(self.ask) + 1))
            q = asked[self.ctx[rest]]
            n = begin[q + 1] - begin[q]
            occ = np.repeat(rest, n)
            w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[q], n)
            hit = flags.astype(bool)[self.win[w]]
            if one:
                hit |= self.win_value[self.win[w]] < own[occ]
            start = self.found.first[self.at[occ]] + self.win_offset[w]
            np.add.at(change, start[hit], 1)
            np.add.at(change, start[hit] + self.found.window, -1)
        return np.cumsum(change[:-1]) > 0


_MESSAGE = "bucket int, block long, step int, keys binary, hashes binary, vals binary"
_ANSWER = "block long, bucket int, step int, flags binary"


def _pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(parts: list[bytes]) -> np.ndarray:
    narrow = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in parts])
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :6] = narrow
    return wide.view("<u8").ravel()


def _pack_values(values: np.ndarray) -> bytes:
    """The smallest value in 8 bytes, then distances from it, in the narrowest
    of 1, 4 or 8 bytes that holds them."""
    low = int(values.min())
    far = int(values.max()) - low
    kind = "<u1" if far < 1 << 8 else "<u4" if far < 1 << 32 else "<u8"
    distance = values.astype(np.int64).view(_U) - np.int64(low).view(_U)
    return np.int64(low).tobytes() + distance.astype(kind).tobytes()


def _unpack_values(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, "<i8", 1)
    kind = {1: "<u1", 4: "<u4", 8: "<u8"}[(len(data) - 8) // n]
    return (np.frombuffer(data, kind, n, 8).astype(_U) + low.view(_U)).view(np.int64)


def _send(block: int, step: int, buckets: int, keys: np.ndarray, cols: dict, known: dict[int, np.ndarray]) -> pa.Table:
    """Messages of a block. Earlier answers go along to one bucket, which sends
    them back (step below 0), so that each answer is worked out once."""
    cuts = _cuts(keys, buckets)
    rows = [(block % buckets, block, -s, flags.tobytes(), b"", b"") for s, flags in known.items() if len(flags)]
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        part = slice(cuts[b], cuts[b + 1])
        hashes = _pack48(cols["hash"][part] >> _U(16)) if "hash" in cols else b""
        rows.append((int(b), block, step, _pack48(keys[part]), hashes, _pack_values(cols["value"][part])))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                    names=["bucket", "block", "step", "keys", "hashes", "vals"])


def _answer(rule: Rule, step: int):
    def run(table: pa.Table) -> pa.Table:
        back = table.filter(pc.less(table.column("step"), 0))
        echo = pa.table([back.column("block"), back.column("bucket"), pc.negate(back.column("step")), back.column("keys")],
                        names=["block", "bucket", "step", "flags"])
        table = table.filter(pc.greater(table.column("step"), 0))
        return pa.concat_tables([echo, settle(table)]) if table.num_rows else echo

    def settle(table: pa.Table) -> pa.Table:
        packed = table.column("keys").to_pylist()
        sizes = np.array([len(k) // 6 for k in packed])
        key = _unpack48(packed)
        value = np.concatenate([_unpack_values(v, n) for v, n in zip(table.column("vals").to_pylist(), sizes)])
        blocks = np.array(table.column("block").to_pylist())
        if step == 1:
            order, begin, group = _groups(key)
            count = np.diff(np.append(begin, len(key)))
            flags = ((count > 1) | (_reduce(np.maximum, value, order, begin) > 0))[group].astype(np.uint8)
        else:
            h = _unpack48(table.column("hashes").to_pylist())
            order, begin, group = _groups(key, h)
            whole = rule.merge(value, order, begin)
            flags = rule.settled(whole[group], value).astype(np.uint8)
            if step == 2:
                contexts_of = np.diff(np.append(_groups(key[order][begin])[1], len(begin)))
                several = np.repeat(contexts_of > 1, contexts_of)
                entry = np.repeat(blocks, sizes)
                speaker = _reduce(np.minimum, entry, order, begin)
                flags |= np.where(several[group], 2, 0).astype(np.uint8) | np.where(entry == speaker[group], 4, 0).astype(np.uint8)
        ends = np.cumsum(sizes)
        out = [flags[e - n:e].tobytes() for e, n in zip(ends, sizes)]
        return pa.table([table.column("block"), table.column("bucket"), pa.array([step] * len(out), pa.int32()),
                         pa.array(out, pa.binary())], names=["block", "bucket", "step", "flags"])

    return run


def mark_repeats(docs: DataFrame, *, id_col: str, text_col: str, unit: str, window: int, seed: int, earlier: bool,
                 render, out_fields: list[T.StructField], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, *out_fields)``: ``row`` holds the columns of ``docs`` other than
    the text; ``render(text bytes, mask of repeated tokens)`` gives the values
    of ``out_fields`` as a tuple."""
    rule = Rule(earlier)
    carried = [c for c in docs.columns if c != text_col]
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b"")) if dict(docs.dtypes)[text_col] == "binary" else \
        F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.struct(*[col(c) for c in carried]).alias("row"),
                       F.coalesce(col(id_col).cast("long"), F.lit(_LAST_ID)).alias("id"), text.alias("text"))
    total = base.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(shuffle_partitions(docs), -(-blocks // BLOCKS_PER_BUCKET))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    split = byte_tokens if unit == "bytes" else word_tokens

    def load(table: pa.Table):
        offsets, data = text_buffers(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.binary()))
        ids = table.column("id").to_numpy()
        tokens, ends = split(data, offsets[1:])
        return offsets, data, ids, ends, find_anchors(tokens, ends, window, seed)

    def answers_of(table: pa.Table) -> dict[int, np.ndarray]:
        steps: dict[int, list] = {}
        for step, bucket, flags in sorted(zip(table.column("step").to_pylist(), table.column("bucket").to_pylist(),
                                              table.column("flags").to_pylist())):
            steps.setdefault(step, []).append(np.frombuffer(flags, np.uint8))
        return {s: np.concatenate(x) for s, x in steps.items()}

    def ordered(table: pa.Table) -> pa.Table:
        """Rows in a fixed order, so that each pass sees the same block."""
        return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))

    def message(step: int, texts: pa.Table, answers: dict[int, np.ndarray]) -> pa.Table:
        _, _, ids, _, found = load(ordered(texts))
        state = Block(found, ids, rule, _complete(answers, step))
        keys, cols = (state.anchors, state.contexts, state.windows)[step - 1]()
        return _send(texts.column("block")[0].as_py(), step, buckets, keys, cols, answers)

    def first_message(texts: pa.Table) -> pa.Table:
        return message(1, texts, {})

    def next_message(step: int):
        def run(texts: pa.Table, said: pa.Table) -> pa.Table:
            return message(step, texts, answers_of(said))
        return run

    def finish(texts: pa.Table, said: pa.Table) -> pa.Table:
        names = ["row"] + [f.name for f in out_fields]
        texts = ordered(texts)
        offsets, data, ids, ends, found = load(texts)
        answers = _complete(answers_of(said), 4)
        state = Block(found, ids, rule, answers)
        size = int(ends[-1]) if len(ends) else 0
        mask = state.covered(size, answers[3])
        begin = np.concatenate(([0], ends[:-1]))
        rows = [render(data[offsets[i]:offsets[i + 1]].tobytes(), mask[begin[i]:ends[i]]) for i in range(len(ids))]
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema_table.schema)[1:])]
        return pa.table([texts.column("row"), *cols], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = T.StructType([base.schema["row"], *out_fields])
    schema_table = to_arrow_schema(out_schema).empty_table()
    texts = dealt.select("block", "id", "row", "text")
    sent = texts.groupBy("block").applyInArrow(first_message, _MESSAGE)
    for step in (1, 2, 3):
        said = sent.groupBy("bucket").applyInArrow(_answer(rule, step), _ANSWER)
        if step < 3:
            sent = texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(next_message(step + 1), _MESSAGE)
    return texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(finish, out_schema)


def _complete(answers: dict[int, np.ndarray], step: int) -> dict[int, np.ndarray]:
    """A block without entries in a step gets no answer to it."""
    return {s: answers.get(s, np.zeros(0, np.uint8)) for s in range(1, step)}
