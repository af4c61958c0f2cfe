"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: one entry per hashed word, one per structure statistic (the interval that
its value lies in), and one each for the recorded length and its absence. Every entry has a weight
and a short vector of factors; the score adds the weights and, for each pair of entries, the inner
product of their factors. The pairs are never listed: for each factor, half of (sum squared minus
sum of squares) over the entries is the same, so scoring is linear in the length of a text.

The machine is fitted by gradient descent on a bounded sample of labelled rows; every row is scored
whole, in Arrow batches of bounded bytes, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.text import bound_batches, word_codes
from turnledger.session import staged

WORD_BITS = 15
FACTORS = 8
SAMPLE = 8_000  # labelled rows the machine is fitted on, at most about
PAIRS = 6_000_000  # entries of these rows, at most about
ROUNDS = 12
BATCH = 64
RATE, DECAY = 0.05, 2e-5
ACCEPTED = 0.3

_UPPER, _LOWER, _DIGIT, _HIGH = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256))
_SYMBOL, _MARK, _BAR = b"#*$%&<>=^~{}[]\\/@_+", b".,;:!?", b"|\t"
#: Limits of the intervals of a share; of a count, powers of two.
_SHARES = np.array([0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95])
STATISTICS = (
    "words", "word length", "symbols", "marks", "shouts", "bars", "digits", "upper", "letters", "beyond ascii", "distinct words",
    "distinct triples", "words like the last", "repeated lines", "words a line", "longest word", "recorded length",
)
INTERVALS = 32
ENTRIES = (1 << WORD_BITS) + len(STATISTICS) * INTERVALS


def _share(part: float, whole: float) -> int:
    return int(np.searchsorted(_SHARES, part / whole, side="left")) if whole else INTERVALS - 1


def _size(value: float) -> int:
    return min(INTERVALS - 2, int(2 * np.log2(1 + value))) if value >= 0 else INTERVALS - 1


def _statistics(data: bytes, words: list[bytes], codes: np.ndarray, recorded: float | None) -> list[int]:
    """The interval of each of STATISTICS."""
    held = lambda drop: len(data) - len(data.translate(None, drop))
    n, chars = len(words), sum(map(len, words))
    upper, lower, high = held(_UPPER), held(_LOWER), held(_HIGH)
    triples = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] if n > 2 else codes
    lines = [line for line in data.split(b"\n") if line.strip()]
    expected = n**0.85  # distinct words grow more slowly than words
    return [
        _size(n), _size(4 * chars / n if n else -1), _share(held(_SYMBOL), chars), _share(held(_MARK), chars), _share(held(b"!"), chars),
        _share(held(_BAR), n), _share(held(_DIGIT), chars), _share(upper, upper + lower), _share(upper + lower + high, chars),
        _share(high, chars), _share(len(np.unique(codes)), expected), _share(len(np.unique(triples)), len(triples)),
        _share(int((codes[1:] == codes[:-1]).sum()), n), _share(len(lines) - len(set(lines)), len(lines)),
        _size(n / len(lines) if lines else -1), _size(max(map(len, words), default=-1)),
        INTERVALS - 1 if recorded is None or not np.isfinite(recorded) or recorded < 0 else _size(recorded),
    ]


@dataclass
class Rows:
    """Sparse rows: the entries of row r are ``at[starts[r] : starts[r + 1]]`` with ``value``."""

    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], size)
        return Rows(starts, self.at[where], self.value[where])


def rows_of(texts: list[str | None], recorded: list[float | None]) -> Rows:
    """Words count by the log of how often they come, scaled to length one in each text; statistics likewise."""
    at, value, size = [], [], []
    shape = np.full(len(STATISTICS), 1 / np.sqrt(len(STATISTICS)), np.float32)
    base = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * INTERVALS
    for text, length in zip(texts, recorded, strict=True):
        data = (text or "").encode(errors="replace")
        codes = word_codes(data)
        hashed, count = np.unique((codes >> np.uint64(64 - WORD_BITS)).astype(np.int32), return_counts=True)
        weight = np.log1p(count)
        at += [hashed, (base + _statistics(data, data.split(), codes, length)).astype(np.int32)]
        value += [(weight / np.sqrt((weight**2).sum() or 1)).astype(np.float32), shape]
        size.append(len(hashed) + len(STATISTICS))
    starts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64)
    return Rows(starts, np.concatenate([np.zeros(0, np.int32), *at]), np.concatenate([np.zeros(0, np.float32), *value]))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # entry x factor

    def parts(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores; the weighted factors of each entry, and their sums per row."""
        scaled = self.factor[rows.at] * rows.value[:, None]
        first = rows.starts[:-1]  # every row has its statistics, so none is empty
        total = np.add.reduceat(scaled, first)
        pairs = (total * total - np.add.reduceat(scaled * scaled, first)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weight[rows.at] * rows.value, first) + pairs, scaled, total

    def scores(self, rows: Rows) -> np.ndarray:
        return _logistic(self.parts(rows)[0].astype(float)) if len(rows.starts) > 1 else np.zeros(0)


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: Rows, good: np.ndarray, rounds: int = ROUNDS) -> Machine:
    """Logistic loss by adaptive gradient descent. Without both labels the machine gives the share of good rows."""
    draw = np.random.Generator(np.random.PCG64(11))
    share = (good.sum() + 1) / (len(good) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(ENTRIES, np.float32), np.zeros((ENTRIES, FACTORS), np.float32))
    if len(set(good.tolist())) < 2:
        return machine
    machine.factor += draw.normal(0, 0.05, machine.factor.shape).astype(np.float32)
    past = np.full((ENTRIES, FACTORS + 1), 1e-4, np.float32)
    past_bias = 1e-4
    for _ in range(rounds):
        shuffled = draw.permutation(len(good))
        for start in range(0, len(good), BATCH):
            chosen = shuffled[start : start + BATCH]
            some = rows.take(chosen)
            raw, scaled, total = machine.parts(some)
            loss = (_logistic(raw) - good[chosen]).astype(np.float32)
            each = np.repeat(np.arange(len(chosen)), np.diff(some.starts))
            steps = np.column_stack([np.ones(len(each), np.float32), total[each] - scaled]) * (loss[each] * some.value)[:, None]
            order = np.argsort(some.at, kind="stable")
            entry, first = np.unique(some.at[order], return_index=True)
            step = np.add.reduceat(steps[order], first) / len(chosen)
            now = np.column_stack([machine.weight[entry], machine.factor[entry]])
            step += DECAY * now
            past[entry] += step**2
            now -= RATE * step / np.sqrt(past[entry])
            machine.weight[entry], machine.factor[entry] = now[:, 0], now[:, 1:]
            slope = float(loss.mean())
            past_bias += slope**2
            machine.bias -= RATE * slope / past_bias**0.5
    return machine


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id's text modulo 5 is 0; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _share_of(hashed: Column, share: float) -> Column:
    """True for about that share of keys, always the same ones."""
    return F.pmod(hashed, F.lit(1_000_003)) < int(min(1.0, share) * 1_000_003)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of what may be learned from; ids with no label, or with both, are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("most"))
    return one.filter("good = most").drop("most")


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, text, n_chars) of about SAMPLE labelled ids at most, one of the rows of an id."""
    known = labelled(labels)
    share = SAMPLE / max(1, known.count())
    chosen = known.filter(_share_of(F.xxhash64("doc_id", F.lit("quality")), share))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("double").alias("n_chars"))
    met = given.join(F.broadcast(chosen), "doc_id")  # SAMPLE rows, give or take a few
    one = F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("row")
    return met.groupBy("doc_id", "good").agg(one).select("doc_id", "good", "row.*")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            rows = rows_of(batch["text"].to_pylist(), batch["n_chars"].to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(rows.starts.astype(np.int32)), pa.array(part)) for part in (rows.at, rows.value)]
            yield pa.record_batch([batch["good"], *lists], names=["good", "at", "value"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on about SAMPLE labelled rows and PAIRS entries at most, which are what the driver holds."""
    bound_batches(docs)
    sample = sampled(docs, labels).select("good", "text", "n_chars")
    table = staged(sample.mapInArrow(_entries, "good int, at array<int>, value array<float>"), "entries")
    pairs = table.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    found = table.filter(_share_of(F.xxhash64("at"), PAIRS / max(1, pairs))).toArrow()
    size = found["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = [found[name].combine_chunks().flatten().to_numpy() for name in ("at", "value")]
    return fit(Rows(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64), *flat), found["good"].to_numpy())


def _score(machine: Machine) -> Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]]:
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, recorded in batches:
            parts, start = [], 0
            while start < len(texts):  # about a megabyte of text at a time, one text at least
                stop, held = start, 0
                while stop < len(texts) and held < 1_000_000:
                    held += len(texts.iloc[stop] or "")
                    stop += 1
                parts.append(machine.scores(rows_of(texts.iloc[start:stop].tolist(), recorded.iloc[start:stop].tolist())))
                start = stop
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return score


def with_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """Add ``score``, from 0 to 1, and ``predicted`` to the rows of ``docs``, replacing columns of these names.

    Null and empty texts are scored by their statistics like any other; a null or negative
    ``n_chars`` is an entry of its own. Equal rows get equal scores. An empty table gives an empty
    result; without labels, or with one label only, every row gets the same score.
    """
    bound_batches(docs)
    score = F.pandas_udf(_score(machine), "double")(F.col("text"), F.col("n_chars").cast("double"))
    scored = docs.drop("score", "predicted").withColumn("score", score)
    return scored.withColumn("predicted", F.when(F.col("score") >= ACCEPTED, 1).otherwise(0))
