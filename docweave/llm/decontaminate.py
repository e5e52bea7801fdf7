"""Benchmark decontamination with one Aho-Corasick automaton.

A window is 13 consecutive words of a benchmark item (an item of fewer words is
one window). The automaton holds every aligned run of 7 words of each item
(each window contains one whole), so it needs a thirteenth of the nodes that
whole windows would. Each text is normalised byte by byte, so offsets carry
over, and scanned once; a match is extended word by word to the longest run
that text and item share there, and a run of a window's length or more marks
its words. Items are a stated set: above ``block_bytes`` of text they are cut
into blocks, each with its own automaton and its own pass over the texts.

Defined cases: null and empty texts have no words and are clean; items without
words are ignored; repeated items each count; an empty benchmark marks nothing;
extra columns are carried untouched.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import as_row, col, text_buffers

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Bytes to normalised bytes: A-Z become a-z, all that ends a word a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HIT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_ARROW_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Matcher:
    """The automaton over the items of one block."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.chunk = window, (window + 1) // 2
        self.ids, self.words = [i for i, _ in items], [words_of(t) for _, t in items]
        patterns: dict[bytes, list] = defaultdict(list)
        for k, words in enumerate(self.words):
            if len(words) < window:
                if words:
                    patterns[b" ".join(words)].append((k, 0))
                continue
            for c in range(0, len(words) - self.chunk + 1, self.chunk):
                patterns[b" ".join(words[c:c + self.chunk])].append((k, c))
        self.automaton = ahocorasick.Automaton() if patterns else None
        for p, places in patterns.items():
            key = " " + p.decode("latin-1") + " "
            self.automaton.add_word(key, (len(key), p.count(b" ") + 1, places))
        if self.automaton is not None:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word runs ``(start, end)`` that windows cover, and the items."""
        runs, items = [], set()
        if self.automaton is None or not words:
            return runs, items
        line = b" " + b" ".join(words) + b" "
        blanks, covered = None, {}
        for end, (size, n, places) in self.automaton.iter(line.decode("latin-1")):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            at = int(np.searchsorted(blanks, end - size + 1))
            for k, c in places:
                item = self.words[k]
                if covered.get((k, at - c), -1) >= at + n:
                    continue
                a, b = at, at + n
                while a > 0 and a - at + c > 0 and words[a - 1] == item[a - at + c - 1]:
                    a -= 1
                while b < len(words) and b - at + c < len(item) and words[b] == item[b - at + c]:
                    b += 1
                covered[k, at - c] = b
                if b - a >= min(self.window, len(item)):
                    runs.append((a, b))
                    items.add(self.ids[k])
        return runs, items


def _spans(text: bytes, mask: np.ndarray) -> list[dict]:
    """Character spans of the marked word runs in the original text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(text.translate(NORMAL), np.uint8) != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    step = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(chars[edges[2 * a]]), "end": int(chars[edges[2 * b - 1]])} for a, b in zip(step[::2], step[1::2])]


def find_contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, hit)``: the document's columns in ``row``; in ``hit`` its number
    of words, of hit words, the items found and the character spans."""
    packed = as_row(docs).select("row", F.lit(None).cast(HIT).alias("hit"))
    stated = items.select(col(item_id).cast("string").alias("id"),
                          F.coalesce(col(item_text).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = T.StructType([packed.schema["row"], T.StructField("hit", HIT)])
    for b in range(blocks):
        part = stated.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else stated
        sent = docs.sparkSession.sparkContext.broadcast([(r["id"] or "", bytes(r["text"])) for r in part.collect()])
        packed = packed.mapInArrow(_scanner(sent, text_col, window), schema)
    return packed


def _scanner(sent, text_col: str, window: int):
    def scan(batches):
        matcher = Matcher(sent.value, window)
        for batch in batches:
            row, before = batch.column("row"), batch.column("hit")
            off, data = text_buffers(row.field(text_col))
            hits = []
            for i in range(batch.num_rows):
                text = data[off[i]:off[i + 1]].tobytes()
                words = words_of(text)
                runs, found = matcher.scan(words)
                spans, n_hit = [], 0
                old = before[i].as_py()
                if old and old["n_hit"]:  # what earlier blocks of items have marked
                    found |= set(old["items"])
                    runs += _word_runs(text, old["spans"])
                if runs:
                    mask = np.zeros(len(words), bool)
                    for a, b in runs:
                        mask[a:b] = True
                    n_hit, spans = int(mask.sum()), _spans(text, mask)
                hits.append({"n_words": len(words), "n_hit": n_hit, "items": sorted(found), "spans": spans})
            yield pa.RecordBatch.from_arrays([row, pa.array(hits, _ARROW_HIT)], names=["row", "hit"])

    return scan


def _word_runs(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    s = text.decode("utf-8", "surrogateescape")
    count = lambda n: len(words_of(s[:n].encode("utf-8", "surrogateescape")))
    return [(count(x["start"]), count(x["end"])) for x in spans]


def contaminated(hit: str = "hit", share: int = 20):
    """A document is contaminated when a window occurs in it and its hit words
    are at least one in ``share``."""
    return (F.col(f"{hit}.n_hit") > 0) & (F.lit(share) * F.col(f"{hit}.n_hit") >= F.col(f"{hit}.n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The clean documents with all their columns."""
    return find_contamination(docs, items, **options).filter(~contaminated()).select("row.*")
