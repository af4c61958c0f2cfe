"""Texts inside Arrow batches, and the row keys that results are joined back by."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of bytes outside space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Stands for a null id inside keys, so that joins on it need no null handling.
NO_ID = -(2**63)


def with_key(docs: DataFrame) -> DataFrame:
    """Add _doc_key and _text_key, never null: rows with one key hold the same doc_id and text."""
    return docs.withColumns({
        "_doc_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "_text_key": F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text")),
    })


def bound_batches(df: DataFrame) -> None:
    """Bound the bytes of an Arrow batch, where the session names no bound: texts can be long.

    Workers then hold some megabytes of texts at a time, whatever ten thousand rows come to.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "4m")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; nulls are empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def word_codes(data: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit code of each word."""
    words = data.split()
    digest = partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def word_count(column: Column) -> Column:
    """Words in a text, by JVM functions; null texts have none."""
    trimmed = F.regexp_replace(column, r"^[\x20\x09-\x0D]+", "")
    parts = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    last = F.when(F.regexp_like(trimmed, F.lit(r"[\x20\x09-\x0D]$")), 1).otherwise(0)
    return F.when(column.isNull() | (trimmed == ""), F.lit(0)).otherwise(parts - last).cast("long")
