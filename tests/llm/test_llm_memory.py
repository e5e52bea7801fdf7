"""Memory that a task of the language model holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docweave.llm import quality_lm as ql


def test_counting_task_holds_little(monkeypatch):
    monkeypatch.setattr(ql, "_CHUNK_CHARS", 1 << 16)
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 115, 40_000))) for _ in range(100)] + [None, ""]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(["a", "b"] * 51), pa.array([i % 2 == 0 for i in range(102)])], names=["text", "lang", "trusted"])
    tracemalloc.start()
    uses = sum(int(np.sum(b.column("uses").to_numpy())) for b in ql._count({"a": 1, "b": 2}, False, 4, False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert uses == 100 * 40_000
    assert peak < 110e6, peak


def test_grams_of_high_code_points():
    texts, order = ["a中\U0001f600b", "", "xy"], 3
    keys, lengths = ql._grams(texts, [1, 0, 2], order)
    code = [c if c < 3072 else 3072 + (c * 0x9E3779B1 % 2**32 >> 22) for c in map(ord, "a中\U0001f600b")]
    want = []
    for lang, classes in ((1, code), (2, [ord("x"), ord("y")])):
        padded = [2, 2, *classes]
        want += [lang << 36 | padded[i] << 24 | padded[i + 1] << 12 | padded[i + 2] for i in range(len(classes))]
    assert keys.tolist() == want and lengths.tolist() == [4, 0, 2]
