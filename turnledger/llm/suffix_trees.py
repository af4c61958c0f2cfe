"""Substring dedup over words by suffixes in groups of a prefix, cut at one depth.

Suffixes are dealt out by ten words that every copy of a window shares, the window's anchor, which
lies inside the window instead of at its start. A group is sorted by its first ``length`` words in one
task; runs of equal ones are the nodes of the suffix tree at that depth, and the smallest document id
below a node owns it. The tree above and below that depth (its edges, longest common prefixes and
maximal repeats) is not built: windows of one length are all that is asked. A group too large for a
task is dealt out by whole windows, which need no sorting. Anchors that a single document has are
dropped before any text moves, and suffixes alike in all their span count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.repeats import Windows, covered, repeated
from turnledger.llm.text import with_key

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text, spans in zip(frame["text"], frame["spans"], strict=True):
            words = (text or "").encode().split()
            kept, removed, output = words, 0, text
            if spans is not None:
                inside, _ = covered(spans, len(words))
                kept, removed = [w for w, gone in zip(words, inside, strict=True) if not gone], int(inside.sum())
            joined = b" ".join(kept)
            if removed:
                output = joined.decode()
            rows.append((len(words), removed, hashlib.sha256(joined).hexdigest(), output))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])
        yield pd.concat([frame.drop(columns=["spans"]), out], axis=1)


def dedup_passages(docs: DataFrame, length: int = 50, prefix: int = 10) -> DataFrame:
    """One row per row of ``docs``, all its columns and n_words, n_removed, kept_sha256, kept.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller
    id, so each passage stays in the first document that has it. Windows are judged on the input.
    ``kept`` is the text itself where nothing goes (null stays null), else the kept words joined by
    one space. Null ids neither lose nor take words; rows that repeat an id do not count against
    each other; an empty table gives an empty result. Columns of ``docs`` with the names of results
    are replaced.
    """
    results = ["n_words", "n_removed", "kept_sha256", "kept"]
    docs = docs.drop(*results, "_doc_key", "_text_key", "spans")
    spans = repeated(docs, Windows(length, prefix, words=True, earlier_only=True))
    joined = with_key(docs).join(spans, ["_doc_key", "_text_key"], "left").drop("_doc_key", "_text_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInPandas(_strip, f"{fields}, n_words long, n_removed long, kept_sha256 string, kept string").select(
        *[F.col(f"`{c}`") for c in docs.columns], *results
    )
