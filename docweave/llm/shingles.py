"""Word-shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from docweave.llm.repeats import mix, word_tokens

SLICE_BYTES = 1 << 20
_U = np.uint64
_STEP = 0x9FB21C651E98DF25


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of texts of about ``limit`` bytes together (one text at least)."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """The set of each text: its distinct runs of ``words`` words (A-Z folded),
    all its words as one run if they are fewer, nothing without words."""
    factors = [_U(pow(_STEP, k + 1, 1 << 64)) for k in range(words)]
    for a, b in slices(offsets):
        lo = int(offsets[a])
        tokens, ends = word_tokens(data[lo:int(offsets[b])], offsets[a + 1:b + 1] - lo, lower=True)
        n = max(0, len(tokens) - words + 1)
        runs = np.zeros(n, _U)
        for k in range(words):
            runs += tokens[k:k + n] * factors[k]
        runs = mix(runs)
        begin = 0
        for end in ends.tolist():
            size = end - begin
            if size >= words:
                found = np.sort(runs[begin:end - words + 1])
                if len(found) > 1:
                    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif size:
                short = np.array([size], _U)
                for k in range(size):
                    short += tokens[begin + k:begin + k + 1] * factors[k]
                found = mix(short)
            else:
                found = runs[:0]
            yield found
            begin = end


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, independent of order."""
    a = int(np.add.reduce(mix(found + _U(0x632BE59BD9B4E019)))) if len(found) else 0
    b = int(np.bitwise_xor.reduce(mix(found * _U(0xD1342543DE82EF95)))) if len(found) else 0
    return _signed(a), _signed(b)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
