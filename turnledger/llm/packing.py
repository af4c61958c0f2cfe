"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are cut into pieces of at most the largest length; nothing is dropped. Pieces, longest first,
go to the open bin that they leave the least room in. If none has room, all lengths compete: each is
filled in thought with the pieces that no open bin was opened for, and the one that costs least for
what it then holds is opened. At the end each bin is downsized to the smallest permitted length that
holds its contents. The same is done with each length alone wherever it is long enough, and the
cheapest packing is taken, so several lengths never cost more than one. Rows are
dealt evenly into shards that are packed on their own, so no task holds more than a shard's lengths
and only a shard's last bins can be worse than those of one long run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.text import word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 50_000  # documents that one task packs

RESULT = (
    "doc_id long, piece int, start long, n_tokens int, bin_id long, capacity int, position int, bin_tokens int"
)


def cost(length: int) -> float:
    """Work of a sequence: linear layers plus attention that grows with the square of the length."""
    return length + length * length / 16_384


class _Rooms:
    """Open bins by the room they have left; finds the least room that is enough."""

    def __init__(self, largest: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(largest + 1)]
        self.used = 0  # bit r is set if a bin has r left

    def take(self, need: int) -> int | None:
        fitting = self.used >> need
        if not fitting:
            return None
        room = need + (fitting & -fitting).bit_length() - 1
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.used ^= 1 << room
        return found

    def put(self, number: int, room: int) -> None:
        if room:
            self.bins[room].append(number)
            self.used |= 1 << room


class _Unclaimed:
    """Counts by size of the pieces to come, and of those that an open bin was opened for."""

    def __init__(self, sizes: np.ndarray, largest: int) -> None:
        self.free = np.bincount(sizes, minlength=largest + 1).tolist()
        self.claimed = [0] * (largest + 1)
        self.used = sum(1 << size for size, n in enumerate(self.free) if n)  # bit s is set if a piece of size s is free

    def take(self, size: int, number: int = 1) -> None:
        self.free[size] -= number
        if not self.free[size]:
            self.used ^= 1 << size

    def placed(self, size: int) -> None:
        if self.claimed[size]:
            self.claimed[size] -= 1
        else:
            self.take(size)

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(size, number) of the free pieces that fill ``room``, largest first."""
        found = []
        while fitting := self.used & ((1 << (room + 1)) - 1):
            size = fitting.bit_length() - 1
            number = min(self.free[size], room // size)
            found.append((size, number))
            room = min(room - size * number, size - 1)
        return found

    def claim(self, found: list[tuple[int, int]]) -> None:
        for size, number in found:
            self.take(size, number)
            self.claimed[size] += number


def pack_least(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """As ``pack``, with all lengths competing for what they can be filled with, and never dearer than one length."""
    total = lambda packed: sum(map(cost, packed[1].tolist()))
    ways = [pack(sizes, lengths, ahead=True), pack(sizes, lengths)]
    ways += [pack(sizes, lengths, least=length) for length in sorted(lengths)[1:]]
    return min(ways, key=total)


def pack(
    sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, ahead: bool = False, least: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The bin number of each piece, and the capacity of each bin. Pieces have 1 to max(lengths) tokens.

    Bins of ``least`` or more are opened. With ``ahead`` the length is chosen by the pieces that can
    still fill it, else by the number of tokens left.
    """
    lengths = sorted(lengths)
    costs = {length: cost(length) for length in lengths}
    unclaimed = _Unclaimed(sizes, lengths[-1]) if ahead else None
    order = np.argsort(-sizes, kind="stable")
    left = int(sizes.sum())
    rooms, filled, room_of = _Rooms(lengths[-1]), [], []
    bins = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        number = rooms.take(size)
        if unclaimed:
            unclaimed.placed(size)
        if number is None:
            able = lengths[bisect_left(lengths, max(size, least)) :]
            if unclaimed:
                fills = {c: unclaimed.fill(c - size) for c in able}
                holds = {c: size + sum(s * n for s, n in fills[c]) for c in able}
                # At the end a bin is as long as what it holds needs.
                length = min(able, key=lambda c: (costs[lengths[bisect_left(lengths, holds[c])]] / holds[c], c))
                unclaimed.claim(fills[length])
            else:
                # A bin can be filled by what is left at most.
                length = min(able, key=lambda c: (costs[c] / min(c, left), c))
            number = len(filled)
            filled.append(0)
            room_of.append(length)
        filled[number] += size
        room_of[number] -= size
        left -= size
        bins[i] = number
        rooms.put(number, room_of[number])
    capacity = [lengths[bisect_left(lengths, tokens)] for tokens in filled]
    return bins, np.array(capacity, np.int64)


def _pack_shard(lengths: Sequence[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    largest = max(lengths)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = pd.concat([pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")}), *frames])
        if not len(docs):
            return
        tokens = docs["n"].to_numpy(np.int64)
        pieces = np.maximum(-(-tokens // largest), 1)
        of = np.repeat(np.arange(len(docs)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(tokens[of] - piece * largest, largest)
        full = size > 0
        bins, capacity = pack_least(size[full], lengths)
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(size[full][order]) - size[full][order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        position = np.zeros(len(bins), np.int64)
        position[order] = ahead - np.repeat(ahead[first], np.diff(np.append(first, len(bins))))
        tally = np.bincount(bins, size[full], len(capacity)).astype(np.int64)
        shard = TaskContext.get().partitionId()
        out = pd.DataFrame({"doc_id": docs["doc_id"].to_numpy()[of], "piece": piece, "start": piece * largest, "n_tokens": size})
        packed = {
            "bin_id": bins + (shard << 32), "capacity": capacity[bins], "position": position, "bin_tokens": tally[bins],
        }
        for name, values in packed.items():
            column = pd.array([pd.NA] * len(out), dtype="Int64")
            column[full] = values
            out[name] = column
        out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
        for start in range(0, len(out), 50_000):
            yield out.iloc[start : start + 50_000]

    return rows


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Where each piece of each text goes: one row per piece of each row of ``docs`` (doc_id, text).

    ``start`` is the piece's first token in its text, ``position`` its place in the bin, tokens are
    words. ``bin_id`` is unique; the pieces of a bin follow each other without gaps from 0 to
    ``bin_tokens``, at most ``capacity``. A null or empty text is one row with no tokens and no
    bin. Repeated rows are packed each; null ids are kept; an empty table gives an empty result;
    other columns are ignored.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n"))
    spark = docs.sparkSession
    shards = max(1, -(-docs.count() // shard_rows))
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * 4)
    return sizes.repartition(max(shards, least)).mapInPandas(_pack_shard(tuple(lengths)), RESULT)
