"""Lengths in byte-pair tokens of a public vocabulary file (one line per
token: its bytes in base 64 and its rank, which is its id)."""

from __future__ import annotations

import base64

MAX_FILE_BYTES = 64 << 20
KEPT = 1 << 18

# Fixed value: the published pattern that cuts text into words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str) -> bytes:
    """The file, its size checked: a fixed table of a few MB."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return data


class TokenCounter:
    """``counter(text)``: number of tokens. Short pieces, words above all, are
    counted once and kept, up to ``KEPT`` of them."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self._encode = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._kept: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if len(text) > 40:
            return len(self._encode(text))
        n = self._kept.get(text)
        if n is None:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            n = self._kept[text] = len(self._encode(text))
        return n


_BUILT: dict[int, TokenCounter] = {}


def counter(vocabulary: bytes) -> TokenCounter:
    """One per worker process."""
    key = hash(vocabulary)
    if key not in _BUILT:
        _BUILT[key] = TokenCounter(vocabulary)
    return _BUILT[key]
