"""Find every window of a fixed number of symbols that stands elsewhere too, exactly and at scale.

1. Each document is cut into anchored spans (``anchors``); a span is one row of ids, its anchor and a
   digest of its real symbols.
2. Per anchor a small aggregate tells whether its windows can repeat at all, and whether all its
   spans are alike. Alike spans are settled there: copies cost one row a span, never a comparison.
3. Of the rest, one representative per distinct span fetches its symbols. They are dealt out by
   anchor and the suffixes that start in them are sorted; neighbours that agree on a whole window
   are a deep node, whose copies or smallest owner are added up from the representatives.
4. An anchor with more than ``group_rows`` spans could outgrow a task: its key is lengthened to
   the whole window, and a hash aggregate with partial sums gives the same classes.

Nothing is capped or dropped: the two ways differ in cost only. Digests of spans (64 bits, told
apart within one anchor) and of windows (128 bits) and codes of words are keyed with a secret drawn
for each run, so no text can be written to make unequal ones meet; by chance two given ones do
with a probability of 2^-64.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm import anchors
from turnledger.llm.text import bound_batches, text_bytes, with_key, word_codes
from turnledger.session import discard, staged

SPAN_SCHEMA = "_doc_key long, _text_key long, first int, count int, anchor long, content long, inner boolean"


@dataclass(frozen=True)
class Windows:
    """What a window is made of."""

    window: int  # symbols
    gram: int  # symbols of an anchor
    words: bool  # symbols are words, else bytes
    earlier_only: bool  # repeats count if they start in a document with a smaller id
    longest: int = 512  # windows of a span
    chunk: int = 1 << 18  # symbols handled at once
    group_rows: int = 20_000  # spans of an anchor that one task sorts
    secret: bytes = field(default_factory=lambda: os.urandom(16))

    @property
    def seed(self) -> int:
        return int.from_bytes(self.secret[:8], "big") | 1

    def digest(self, symbols: Sequence[bytes] | bytes, size: int) -> bytes:
        """A keyed digest of bytes, or of words, which hold no space."""
        whole = b" ".join(symbols) if self.words else symbols
        return hashlib.blake2b(whole, digest_size=size, key=self.secret).digest()


def _codes(data: bytes, spec: Windows) -> np.ndarray:
    return word_codes(data, spec.seed) if spec.words else anchors.BYTE_CODES[np.frombuffer(data, np.uint8)]


Piece = tuple[int, int, int, np.ndarray, Sequence[bytes] | bytes]


def _pieces(batches: Iterator[pa.RecordBatch], spec: Windows) -> Iterator[list[Piece]]:
    """(id, hash, offset, codes, symbols) lists of about ``chunk`` symbols; long texts are cut with an overlap."""
    held: list[Piece] = []
    size = 0
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, data in enumerate(text_bytes(batch.column(2))):
            codes = _codes(data, spec)
            symbols = data.split() if spec.words else data
            for offset in range(0, max(1, len(codes) - spec.window + 1), spec.chunk):
                part = slice(offset, offset + spec.chunk + spec.window - 1)
                if len(codes[part]) >= spec.window:
                    held.append((ids[i], hashes[i], offset, codes[part], symbols[part]))
                    size += len(codes[part])
                if size >= spec.chunk:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _span_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches, spec):
            ends = np.cumsum([len(piece[3]) for piece in held])
            found = anchors.spans(np.concatenate([piece[3] for piece in held]), ends, spec.window, spec.gram, spec.longest)
            if found is None:
                continue
            of = np.searchsorted(ends, found.first, side="right")
            ids, hashes, offsets = (np.array(column, np.int64) for column in zip(*[h[:3] for h in held], strict=True))
            starts = ends - np.array([len(piece[3]) for piece in held])
            first = found.first - starts[of]
            stop = first + found.count - 1 + spec.window
            content = b"".join([spec.digest(held[k][4][a:b], 8) for k, a, b in zip(of.tolist(), first.tolist(), stop.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[of]), pa.array(hashes[of]),
                    pa.array((first + offsets[of]).astype(np.int32)),
                    pa.array(found.count.astype(np.int32)), pa.array(found.anchor.view(np.int64)),
                    pa.array(np.frombuffer(content, np.int64)), pa.array(found.inner),
                ],
                names=["_doc_key", "_text_key", "first", "count", "anchor", "content", "inner"],
            )

    return rows


def _contents(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Give each representative span of a text its symbols, as bytes of fixed-width codes."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for text, spans in zip(frame["text"], frame["spans"], strict=True):
                data = text.encode()
                symbols = word_codes(data, spec.seed).astype(">u8") if spec.words else np.frombuffer(data, np.uint8)
                parts += [
                    (s["anchor"], s["content"], s["copies"], s["owner"], s["large"],
                     symbols[s["first"] : s["first"] + s["count"] - 1 + spec.window].tobytes())
                    for s in spans
                ]
            yield pd.DataFrame(parts, columns=["anchor", "content", "copies", "owner", "large", "symbols"])

    return rows


def _windows_of(symbols: list[bytes], spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: place in the joined symbols, span number, number in the span; and the symbols."""
    joined = np.frombuffer(b"".join(symbols), ">u8" if spec.words else np.uint8)
    width = 8 if spec.words else 1
    sizes = np.array([len(s) // width for s in symbols])
    counts = sizes - spec.window + 1
    span = np.repeat(np.arange(len(symbols)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.cumsum(sizes) - sizes, counts) + number, span, number, joined


def _hashes(place: np.ndarray, joined: np.ndarray, spec: Windows) -> np.ndarray:
    codes = joined.astype(np.uint64) if spec.words else anchors.BYTE_CODES[joined]
    return anchors.ranges_hash(anchors.prefix_sums(codes, 0), 0, place, place + spec.window)


def _slices(starts: np.ndarray, size: int, rows: int) -> Iterator[tuple[int, int]]:
    """Cut [0, size) at some of ``starts`` into pieces of about ``rows``."""
    low = 0
    while low < size:
        at = np.searchsorted(starts, low + rows, side="right") - 1
        high = size if low + rows >= size else int(starts[at])
        if high <= low:  # one class is larger than a piece
            high = int(starts[at + 1]) if at + 1 < len(starts) else size
        yield low, high
        low = high


def _nodes(frame: pd.DataFrame, spec: Windows) -> pd.DataFrame:
    """Deep nodes of the suffixes that start in the spans of some anchors.

    Suffixes whose window hash is alone under its anchor are leaves and are left out; the others
    are sorted by their first ``window`` symbols, and equal neighbours fall into one node.
    """
    frame = frame.drop_duplicates(["anchor", "content"], ignore_index=True)  # fetched from rows that repeat
    place, span, number, joined = _windows_of(frame["symbols"].tolist(), spec)
    anchor = frame["anchor"].to_numpy()[span]
    key = _hashes(place, joined, spec) ^ anchors.mixed(anchor.view(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    # A window of a span with copies is repeated even if no other span has it.
    copies, owner = frame["copies"].to_numpy()[span], frame["owner"].to_numpy()[span]
    value = owner.copy() if spec.earlier_only else copies.copy()
    at = order[shared[order]]  # in order of key, so that equal windows are neighbours
    starts = np.flatnonzero(np.diff(key[at], prepend=~key[at[:1]]) != 0)
    for low, high in _slices(starts, len(at), 50_000):
        some = at[low:high]
        wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, spec.window)[place[some]])
        sort = np.lexsort((wide.view(f"S{wide.shape[1] * wide.itemsize}").ravel(), anchor[some]))
        some, wide = some[sort], wide[sort]
        edge = np.ones(len(some), bool)
        edge[1:] = (wide[1:] != wide[:-1]).any(axis=1) | (anchor[some][1:] != anchor[some][:-1])
        total = (np.minimum if spec.earlier_only else np.add).reduceat(value[some], np.flatnonzero(edge))
        value[some] = total[np.cumsum(edge) - 1]
    # Neighbouring windows of a span with one value become one row.
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (span[1:] != span[:-1])
    begin = np.flatnonzero(fresh)
    return pd.DataFrame({
        "anchor": anchor[begin], "content": frame["content"].to_numpy()[span[begin]], "start": number[begin].astype(np.int32),
        "windows": np.diff(np.append(begin, len(value))).astype(np.int32), "value": value[begin],
    })


def _sorted_groups(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows come in order of anchor; the last anchor of a batch waits for the next one."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for start in range(0, len(frame), 1000):
                part = frame.iloc[start : start + 1000]
                last = part["anchor"].iloc[-1]
                if held and held[0]["anchor"].iloc[0] == last and len(part) and part["anchor"].iloc[0] == last:
                    held.append(part)
                    continue
                ready = pd.concat([*held, part[part["anchor"] != last]], ignore_index=True)
                held = [part[part["anchor"] == last]]
                if len(ready):
                    yield _nodes(ready, spec)
        if held:
            yield _nodes(pd.concat(held, ignore_index=True), spec)

    return rows


def _lengthened(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row per window, keyed by a digest of the whole window."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 500):
                part = frame.iloc[start : start + 500]
                place, span, number, joined = _windows_of(part["symbols"].tolist(), spec)
                data, width = joined.tobytes(), joined.itemsize
                whole = b"".join([
                    hashlib.blake2b(data[p * width : (p + spec.window) * width], digest_size=16, key=spec.secret).digest() for p in place.tolist()
                ])
                one, two = np.frombuffer(whole, np.int64).reshape(-1, 2).T
                columns = {name: part[name].to_numpy()[span] for name in ("anchor", "content", "copies", "owner")}
                yield pd.DataFrame({**columns, "start": number.astype(np.int32), "one": one, "two": two})

    return rows


def repeated(docs: DataFrame, spec: Windows) -> DataFrame:
    """(_doc_key, _text_key, spans): places [start, stop) of symbols that repeated windows cover, per document key.

    Documents without any are absent. Spans may overlap and are in no order. Rows with a null id
    take part for byte windows; for ``earlier_only`` they neither lose nor take anything.
    """
    bound_batches(docs)
    keyed = with_key(docs.select("doc_id", "text"))
    texts = keyed.select("_doc_key", "_text_key", "text")
    known = keyed.filter("doc_id IS NOT NULL") if spec.earlier_only else keyed
    cut = known.select("_doc_key", "_text_key", "text").mapInArrow(_span_rows(spec), SPAN_SCHEMA)
    whole = staged(cut, "spans")
    table = whole
    facts = [F.min("content").alias("c0"), F.max("content").alias("c1"), F.count("*").alias("runs")]
    if spec.earlier_only:
        facts += [F.min("_doc_key").alias("low"), F.max("_doc_key").alias("high")]
        repeats, alike, loses = F.expr("low < high"), F.expr("c0 = c1"), F.expr("low < _doc_key")
        table = table.drop("inner")
    else:
        facts += [F.max("inner").alias("twice")]
        repeats, alike, loses = F.expr("runs > 1 OR twice"), F.expr("c0 = c1 AND NOT twice"), F.lit(True)
    seen = table.groupBy("anchor").agg(*facts).filter(repeats).withColumns({"alike": alike, "large": F.col("runs") > spec.group_rows})
    seen = seen.drop("c0", "c1", "runs", "high", "twice")
    shared = staged(table.drop("inner").join(seen, "anchor"), "shared")
    discard(whole)  # the shared spans are stored on their own
    plain = shared.filter(F.col("alike") & loses).select(
        "_doc_key", "_text_key", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + spec.window).alias("stop")
    )
    unlike = shared.filter(~F.col("alike"))
    chosen = unlike.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min("_doc_key").alias("owner"), F.first("large").alias("large"),
        F.min(F.struct("_doc_key", "_text_key", "first", "count")).alias("at"),
    )
    wanted = chosen.groupBy("at._doc_key", "at._text_key").agg(
        F.collect_list(F.struct("anchor", "content", "copies", "owner", "large", "at.first", "at.count")).alias("spans")
    )
    # Rows that repeat an id and a text are alike: the representative is taken from each, and counted once.
    fetched = texts.join(wanted, ["_doc_key", "_text_key"]).select("text", "spans").mapInPandas(
        _contents(spec), "anchor long, content long, copies long, owner long, large boolean, symbols binary"
    )
    return _joined_back(plain, unlike, fetched, spec)


def _joined_back(plain: DataFrame, unlike: DataFrame, fetched: DataFrame, spec: Windows) -> DataFrame:
    by_sort = (
        fetched.filter("NOT large").drop("large").repartition("anchor")
        .sortWithinPartitions("anchor").mapInPandas(_sorted_groups(spec), "anchor long, content long, start int, windows int, value long")
    )
    exploded = fetched.filter("large").dropDuplicates(["anchor", "content"]).mapInPandas(
        _lengthened(spec), "anchor long, content long, copies long, owner long, start int, one long, two long"
    )
    whole = exploded.groupBy("one", "two").agg((F.min("owner") if spec.earlier_only else F.sum("copies")).alias("value"))
    by_hash = exploded.join(whole, ["one", "two"]).select("anchor", "content", "start", F.lit(1).alias("windows"), "value")
    found = by_sort.unionByName(by_hash)
    if not spec.earlier_only:
        found = found.filter("value > 1")
    hit = unlike.select("anchor", "content", "_doc_key", "_text_key", "first").join(found, ["anchor", "content"])
    if spec.earlier_only:
        hit = hit.filter("value < _doc_key")
    start = F.col("first") + F.col("start")
    spans = plain.unionByName(hit.select("_doc_key", "_text_key", start.alias("start"), (start + F.col("windows") - 1 + spec.window).alias("stop")))
    return spans.groupBy("_doc_key", "_text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def covered(spans: list | np.ndarray | None, size: int) -> tuple[np.ndarray, int]:
    """Which of ``size`` symbols lie in a span, and how many maximal runs they form."""
    step = np.zeros(size + 1, np.int32)
    if spans is not None and len(spans):
        np.add.at(step, [s["start"] for s in spans], 1)
        np.add.at(step, [s["stop"] for s in spans], -1)
    inside = np.cumsum(step[:-1]) > 0
    return inside, int((np.diff(inside.astype(np.int8), prepend=0) == 1).sum())
