"""Removal of repeated token spans after the idea of a compacted de Bruijn
graph: edges are sampled and exchanged by hash, no edge table is joined.

Tokens are words; the k-mers of ``seed`` words are the edges of a de Bruijn
graph, of which each window of ``window`` words keeps its smallest by hash. An
edge that occurs once is dropped after one exchange. Of the others, the whole
stretch of windows around an edge is one compacted path: where all occurrences
of an edge lie on equal stretches the path does not branch and is settled as a
whole by its multiplicity; only at branching edges are single windows compared.
Every answer goes back to source coordinates (document, word), where windows
are marked. ``repeats`` holds the exchanges.

Defined cases: null and empty texts have no words; texts of fewer than
``window`` words keep all; repeated rows count as occurrences of each other;
null ids are ordinary rows; an empty table gives an empty result; extra columns
are carried in ``row``.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.repeats import mark_repeats

WINDOW = 35
SEED = 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def mask_spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def remove_repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                          seed: int = SEED, **options) -> DataFrame:
    """``(row, n_words, n_removed, spans, kept)``: word spans removed and the
    kept words joined by one space. Each word covered by a window whose words
    also start anywhere else is removed, wherever it stands."""

    def render(text: bytes, mask: np.ndarray):
        words = text.split()
        if mask.any():
            kept = b" ".join(compress(words, (~mask).tolist()))
            return len(words), int(mask.sum()), mask_spans(mask), kept.decode("utf-8", "replace")
        return len(words), 0, [], b" ".join(words).decode("utf-8", "replace")

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("spans", SPANS), T.StructField("kept", T.StringType())]
    return mark_repeats(docs, id_col=id_col, text_col=text_col, unit="words", window=window, seed=seed, earlier=False,
                        render=render, out_fields=fields, **options)
