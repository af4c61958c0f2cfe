"""Substring dedup over bytes by prefix-free parsing, without its suffix arrays.

Rolling-hash triggers (the smallest hash of each window, see ``anchors``) cut every text into
phrases. Neighbouring phrases overlap by one byte less than the window, so no phrase is a prefix of
the next place's phrase and each window lies whole in one phrase. The distinct phrases are the
dictionary, and the parse says where each one stands and how often.

What is asked are windows of one length, and each lies inside one phrase. So the dictionary is
sorted by windows inside the groups of one trigger, not as one suffix array, and of the parse only
its counts are needed, not its suffix array: the order of the corpus beyond a window changes no
answer. Work grows with the dictionary, not with the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from turnledger.llm.repeats import Windows, covered, repeated
from turnledger.llm.text import with_key

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
            data = (text or "").encode()
            kept, removed, runs = data, 0, 0
            if spans is not None:
                inside, runs = covered(spans, len(data))
                kept, removed = np.frombuffer(data, np.uint8)[~inside].tobytes(), int(inside.sum())
            rows.append((doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        yield out.astype({"doc_id": "Int64"})


def dedup_substrings(docs: DataFrame, length: int = 200, trigger: int = 48) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is left without bytes of repeated strings.

    A byte goes if a string of ``length`` bytes over it starts anywhere else too, in this document
    or another; all copies go. Strings are judged on the input and never cross documents. Null and
    empty texts keep zero bytes; null ids take part; repeated rows are copies of each other, so
    long ones lose everything; an empty table gives an empty result; other columns are ignored.
    ``kept`` holds the remaining bytes, which may cut a character in two.
    """
    spans = repeated(docs, Windows(length, trigger, words=False, earlier_only=False))
    keyed = with_key(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"))
    return keyed.join(spans, ["_doc_key", "_text_key"], "left").select("doc_id", "text", "spans").mapInPandas(_strip, RESULT)
