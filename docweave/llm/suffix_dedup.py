"""Removal of byte strings that an earlier document holds, by an exchange of
sampled runs. No suffixes are sorted; the README says where this departs from
external induced sorting.

Of the byte runs that start in a window of ``window`` bytes only one is sampled,
the one whose first ``seed`` bytes have the smallest hash, so equal windows
sample at equal offsets. Samples are dealt to buckets by ranges of their hash;
those of one hash are told apart by a hash of the stretch around them, and the
positions between two samples are induced from the sample they belong to:
equal stretches settle all of them, and only where stretches differ are single
windows compared. ``repeats`` holds the exchanges; see README for what this
shares with suffix-array construction and what not.

Defined cases: null text is empty; texts of fewer than ``window`` bytes keep
all; null ids come after all others; rows with equal ids never remove from each
other; an empty table gives an empty result; extra columns are carried in
``row``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.debruijn import SPANS, mask_spans
from docweave.llm.repeats import mark_repeats

WINDOW = 50
SEED = 27


def remove_earlier_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                              seed: int = SEED, **options) -> DataFrame:
    """``(row, n_bytes, n_removed, spans, kept)``: byte spans removed and the
    remaining bytes. Each byte covered by a ``window``-byte string that also
    starts in a document with a smaller id is removed."""

    def render(text: bytes, mask: np.ndarray):
        if mask.any():
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            return len(text), int(mask.sum()), mask_spans(mask), kept
        return len(text), 0, [], text

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]
    return mark_repeats(docs, id_col=id_col, text_col=text_col, unit="bytes", window=window, seed=seed, earlier=True,
                        render=render, out_fields=fields, **options)
