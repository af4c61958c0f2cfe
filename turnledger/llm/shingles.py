"""Join classes of texts that hold texts of like five-word shingles.

MinHash bands only propose: texts that share a band and are of different classes are compared by
their whole sets of shingles, and linked if the Jaccard similarity is large enough. At a
similarity of 0.8 or more a pair shares no band with a chance of 6 in 100,000 or less.

The bands are gone through in a few rounds. Classes joined in one round are one class in the next, so
most near copies meet once and not in every band they share. Only the texts of a band that still
has several classes are fetched and sent out, once per such band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.components import stars
from turnledger.llm.text import bound_batches, word_codes
from turnledger.session import broadcast_if_small, discard, staged

WORDS = 5
BANDS, ROWS = 32, 6
ROUNDS = (0, 3, 8, 16, BANDS)
PART = 4_000  # texts of a band compared in one task, about; more are split into pairs of parts
PART_CODES = 4_000_000  # and their shingles, about
FEW = 500_000  # texts to fetch whose keys are sent to every task; more are joined by a shuffle
_DRAW = np.random.default_rng(17)
_FLIP, _TIMES = _DRAW.integers(0, 2**64, BANDS * ROWS, np.uint64), _DRAW.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(32))


def shingles(data: bytes) -> np.ndarray:
    """Distinct 64-bit codes of a text's runs of five words, ASCII case apart; a shorter text is one run."""
    codes = word_codes(data.lower())
    if not len(codes):
        return codes
    size = min(WORDS, len(codes))
    runs = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(runs)])
    return np.unique(runs)


def bands(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band: its smallest codes under ``ROWS`` orders."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(codes), 1024):
        part = codes[start : start + 1024, None]
        np.minimum(least, ((part ^ _FLIP) * _TIMES).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [shingles((text or "").encode()) for text in frame["text"]]
        yield pd.DataFrame({
            "_doc_key": frame["_doc_key"], "_text_key": frame["_text_key"],
            "unit": np.array([xxhash.xxh64_intdigest(f.tobytes()) for f in found], np.uint64).view(np.int64),
            "size": np.array([len(f) for f in found], np.int64), "bands": [bands(f) if len(f) else None for f in found],
        })


def _codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"unit": frame["unit"], "codes": [shingles((text or "").encode()).tobytes() for text in frame["text"]]})


def _compare(similar: float):
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of (band, pair); the last group of a batch waits for the next batch."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            keys = frame[["band", "pair"]].to_numpy()
            ends = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            if held and (held[-1][["band", "pair"]].to_numpy()[-1] != keys[0]).any():
                ends = [0, *ends]
            start = 0
            for end in ends:
                yield links([*held, frame[start:end]])
                held, start = [], end
            held.append(frame[start:])
        if held:
            yield links(held)

    def links(parts: list[pd.DataFrame]) -> pd.DataFrame:
        group = pd.concat(parts, ignore_index=True)
        kind, label = np.unique(group["class"].to_numpy(), return_inverse=True)
        a, b = joined([np.frombuffer(codes, np.uint64) for codes in group["codes"]], label, similar)
        return pd.DataFrame({"a": kind[a], "b": kind[b]})

    return compare


def joined(sets: list[np.ndarray], label: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """Pairs of labels that join the classes of all sets of a similarity of ``similar`` or more."""
    label, a, b = label.copy(), [], []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, stop = owner[order], np.cumsum(np.bincount(code))
    first = stop - np.bincount(code)
    begin = np.cumsum(size) - size
    own_label = label.copy()
    for i in range(len(sets)):
        if (label == label[i]).all():
            continue
        mine = code[begin[i] : begin[i] + size[i]]
        counts = stop[mine] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        # Compared as whole numbers where they are: 0.8 is 4 of 5.
        near = (both >= similar * (size + size[i] - both) - 1e-9) & (label != label[i])
        for j in np.flatnonzero(near):
            if label[j] != label[i]:
                a.append(own_label[i])
                b.append(own_label[j])
                label[label == label[j]] = label[i]
    return a, b


def _mixed_bands(units: DataFrame, low: int, high: int) -> DataFrame:
    """(band, pair, unit, class) of the texts to compare: those of bands ``low`` to ``high`` with several classes."""
    members = units.select("unit", "class", "size", F.explode(F.slice("bands", low + 1, high - low)).alias("band"))
    held = members.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("codes"), F.min("class").alias("least"), F.max("class").alias("most"),
        F.expr("bit_xor(xxhash64(unit, class))").alias("who"),
    )
    # Bands with the same texts are compared once.
    mixed = held.filter("least < most").groupBy("n", "who").agg(F.min("band").alias("band"), F.first("codes").alias("codes"))
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("codes") / PART_CODES)).cast("long")
    part = F.pmod(F.xxhash64("unit", "class"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = members.join(mixed.withColumn("parts", parts).select("band", "parts"), "band").withColumn("part", part).withColumn("other", other)
    return dealt.select("band", "unit", "class", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("pair"))


def join_classes(keyed: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """(class, joined) of the classes that links of texts join to a class with a smaller number.

    ``keyed`` has _doc_key, _text_key and text, ``classes`` the first two and class. Texts without words
    are not compared; an empty table, or one whose bands hold one class each, gives an empty result.
    """
    bound_batches(keyed)
    texts = keyed.select("_doc_key", "_text_key", "text")
    sets = staged(texts.mapInPandas(_sets, "_doc_key long, _text_key long, unit long, size long, bands array<long>"), "bands")
    known = sets.filter("bands IS NOT NULL").join(classes.select("_doc_key", "_text_key", "class").distinct(), ["_doc_key", "_text_key"])
    at = F.min(F.struct("_doc_key", "_text_key")).alias("at")
    # One row per set of shingles and class, and one text that has the set.
    units = staged(known.groupBy("unit", F.col("class").alias("begun")).agg(at, F.first("size").alias("size"), F.first("bands").alias("bands")), "units")
    discard(sets)
    star = keyed.sparkSession.createDataFrame([], "a long, b long")
    for low, high in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        now = units.join(star, units["begun"] == star["a"], "left").select("unit", "size", "bands", F.coalesce("b", "begun").alias("class"))
        dealt = staged(_mixed_bands(now, low, high), "dealt")
        if dealt.isEmpty():
            discard(dealt)
            continue
        wanted = units.join(dealt.select("unit").distinct(), "unit", "left_semi").groupBy("unit").agg(F.min("at").alias("at"))
        wanted = staged(wanted.select("unit", "at.*"), "wanted")
        fetched = texts.join(broadcast_if_small(wanted, FEW), ["_doc_key", "_text_key"]).select("unit", "text")
        codes = fetched.mapInPandas(_codes, "unit long, codes binary").dropDuplicates(["unit"])
        sent = dealt.join(codes, "unit").select("band", "pair", "class", "codes")
        links = staged(sent.repartition("band", "pair").sortWithinPartitions("band", "pair").mapInPandas(_compare(similar), "a long, b long"), "links")
        for done in (dealt, wanted):
            discard(done)
        if not links.isEmpty():
            before, star = star, stars(star.unionByName(links))
            discard(before)
        discard(links)
    discard(units)
    return star.select(F.col("a").alias("class"), F.col("b").alias("joined"))
