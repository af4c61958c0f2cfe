"""SimHash near-dedup with vantage-point trees.

Fingerprints lie in the metric space of Hamming distance. A tree of vantage points, fitted on a
bounded sample, deals the distinct fingerprints out to shards: inside a vantage point's radius or
outside of it. By the triangle inequality the partners of an inner fingerprint lie within the
radius plus the link distance, so outer ones of that boundary go to the inner shard as well, and
every pair within the distance meets in some shard. A shard searches itself with a tree of its own,
pruned by the same bound, down to blocks that are compared directly, and reports a spanning forest
of its links: enough for classes, never all pairs of a group. Exact copies are one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.components import stars
from turnledger.llm.shingles import join_classes
from turnledger.llm.text import bound_batches, with_key
from turnledger.session import staged

BLOCK = 768  # fingerprints compared directly
SHARD = 2_000  # fingerprints that a shard should own
SAMPLE = 32_768  # fingerprints that the tree of shards is fitted on, about
HEAVY = 60_000  # a shard with more rows, as a dense cloud has, is split into pairs of parts


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; repeated shingles count again."""
    words = data.lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    cuts = zip((stops - sizes).tolist(), stops[shingle - 1 :].tolist(), strict=False)
    hashes = np.array([digest(joined[a:b], 42) for a, b in cuts], "<u8")
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 100_000 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((counts * 2 > len(hashes)) @ (1 << np.arange(64, dtype=np.uint64)))


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = [fingerprint((text or "").encode()) for text in frame["text"]]
        yield pd.DataFrame({"_doc_key": frame["_doc_key"], "_text_key": frame["_text_key"], "doc_id": frame["doc_id"].astype("Int64"),
                            "print": np.array(prints, np.uint64).view(np.int64)})


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(prints: np.ndarray, reach: int) -> tuple[np.uint64, int, float]:
    """A vantage point, its radius, and the share of rows that the larger side would still hold.

    Of a few evenly spaced rows and every radius the one with the least rows in both sides is taken.
    """
    best = (prints[0], 0, 1.0)
    for i in range(0, len(prints), max(1, len(prints) // 6)):
        upto = np.cumsum(np.bincount(distances(prints, prints[i]), minlength=65 + reach)) / len(prints)
        inner, outer = upto[reach:65], 1 - upto[: 65 - reach]
        larger = np.maximum(inner, outer)
        at = int(larger.argmin())
        if larger[at] < best[2]:
            best = (prints[i], at, float(larger[at]))
    return best


@dataclass
class Node:
    """A split of fingerprints by their distance from a vantage point, or a shard."""

    shard: int = -1
    parts: int = 1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None


def fit(sample: np.ndarray, scale: float, reach: int, shard: int = SHARD, heavy: int = HEAVY) -> Node:
    """A tree of shards; a row of the sample stands for ``scale`` fingerprints."""
    made = 0

    def grow(rows: np.ndarray, own: int) -> Node:
        nonlocal made
        if own * scale > shard and own >= 16:
            point, radius, larger = vantage(rows, reach)
            if larger < 0.85:
                away = distances(rows, point)
                share = own / len(rows)
                inner, outer = rows[away <= radius + reach], rows[away > radius]
                mine = int(share * (away <= radius).sum())
                return Node(point=point, radius=radius, inner=grow(inner, mine), outer=grow(outer, own - mine))
        made += 1
        return Node(shard=made - 1, parts=max(1, int(-(-len(rows) * scale // heavy))))

    return grow(sample, len(sample))


def _deal(tree: Node, reach: int):
    """Send each fingerprint to every shard whose owners it may be linked to."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = frame["print"].to_numpy().view(np.uint64)
            todo = [(tree, prints)]
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if node.shard < 0:
                    away = distances(rows, node.point)
                    todo += [(node.inner, rows[away <= node.radius + reach]), (node.outer, rows[away > node.radius])]
                    continue
                part = ((rows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % node.parts
                for other in range(node.parts):
                    pair = np.minimum(part, other) * node.parts + np.maximum(part, other)
                    yield pd.DataFrame({"shard": node.shard, "pair": pair, "print": rows.view(np.int64)})

    return deal


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of each a and b; labels are the smallest row number of a class."""
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def classes(prints: np.ndarray, reach: int, block: int = BLOCK) -> np.ndarray:
    """For each distinct fingerprint the row number of its class: chains of links within ``reach``."""
    labels = np.arange(len(prints))
    todo = [labels.copy()]
    while todo:
        rows = todo.pop()
        if len(rows) > block:
            point, radius, larger = vantage(prints[rows], reach)
            if larger < 0.9:
                away = distances(prints[rows], point)
                todo += [rows[away <= radius + reach], rows[away > radius]]
                continue
        for i in range(0, len(rows), block):
            for j in range(i, len(rows), block):
                one, two = rows[i : i + block], rows[j : j + block]
                a, b = np.nonzero(distances(prints[one][:, None], prints[two][None, :]) <= reach)
                labels = _merge(labels, one[a], two[b])
    return labels


def _link(reach: int):
    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of (shard, pair); the last one of a batch waits for the next batch."""
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held.iloc[-1]
            waits = (held["shard"] == last["shard"]) & (held["pair"] == last["pair"])
            ready, held = held[~waits], held[waits]
            yield from links(ready)
        if held is not None:
            yield from links(held)

    def links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, group in frame.groupby(["shard", "pair"], sort=False):
            prints = group["print"].to_numpy().view(np.uint64)
            labels = classes(prints, reach)
            member = labels != np.arange(len(labels))
            yield pd.DataFrame({"a": prints[member].view(np.int64), "b": prints[labels[member]].view(np.int64)})

    return link


def near_duplicates(docs: DataFrame, reach: int = 3) -> DataFrame:
    """(print, _doc_key, _text_key, doc_id, class, component_id): one row per row of ``docs`` (doc_id, text).

    Texts whose fingerprints differ in ``reach`` or fewer bits are linked; ``component_id`` is the
    smallest doc_id that links reach. Texts without words, null ones too, have fingerprint zero and
    are linked like others. Null ids are members but never a smallest id (null if a class has no
    other); repeated rows give repeated rows; an empty table gives an empty result; other columns
    are ignored.
    """
    bound_batches(docs)
    keyed = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    columns = "_doc_key long, _text_key long, doc_id long, print long"
    prints = staged(keyed.select("_doc_key", "_text_key", "doc_id", "text").mapInPandas(_fingerprints, columns), "prints")
    distinct = staged(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    total = distinct.count()
    every = max(1, total // SAMPLE)
    drawn = distinct.filter(F.pmod(F.xxhash64("print"), F.lit(every)) == 0).select("print")
    sample = np.array([row[0] for row in drawn.collect()], np.int64).view(np.uint64)
    links = _search(distinct, fit(np.sort(sample), every, reach) if len(sample) else Node(shard=0), reach)
    star = stars(links)
    member = distinct.join(star, distinct["print"] == star["a"], "left").select(
        "print", "least", F.coalesce("b", "print").alias("class")
    )
    least = member.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints.join(member.join(least, "class").select("print", "class", "component_id"), "print")


def _search(distinct: DataFrame, tree: Node, reach: int) -> DataFrame:
    dealt = distinct.select("print").mapInPandas(_deal(tree, reach), "shard int, pair long, print long")
    return dealt.repartition("shard", "pair").sortWithinPartitions("shard", "pair").mapInPandas(_link(reach), "a long, b long")


def hexadecimal(name: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def one_of_each(docs: DataFrame, reach: int = 3, similar: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays.

    With ``similar``, texts whose sets of five-word shingles have that Jaccard similarity or more are
    linked as well, however far apart their fingerprints are.
    Null ids come last; rows that tie on the id are told apart by their text, and of equal rows one
    stays. All columns are kept as they are.
    """
    found = near_duplicates(docs, reach)
    if similar is not None:
        found = staged(found.select("_doc_key", "_text_key", "doc_id", "class"), "classes")
        more = join_classes(with_key(docs.select("doc_id", "text")), found, similar)
        found = found.join(more, "class", "left").withColumn("class", F.coalesce("joined", "class"))
    first = F.row_number().over(Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last(), "_text_key"))
    chosen = found.withColumn("n", first).filter("n = 1").select("_doc_key", "_text_key")
    copy = F.row_number().over(Window.partitionBy("_doc_key", "_text_key").orderBy(F.lit(1)))
    kept = with_key(docs).join(chosen, ["_doc_key", "_text_key"]).withColumn("_copy", copy).filter("_copy = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
