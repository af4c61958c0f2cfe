"""Quality filtering by weak supervision instead of all rules having to pass.

Each rule votes good, votes bad or abstains. Expectation-maximisation estimates how often a rule
votes which way on good and on bad texts, without labels, and gives each text a posterior
probability of being good. Texts with the same votes are alike to the model, so it is fitted on
the counts of vote patterns of all documents: at most 3 to the power of the number of rules rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm import anchors
from turnledger.llm.text import bound_batches, word_codes
from turnledger.session import staged

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER, _HIGH = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_bars")


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def _plain_metrics(text: str, data: bytes, words: list[bytes]) -> tuple[int, ...]:
    seen: set[bytes] = set()
    lines = again = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    beyond_ascii = len(text) - len(data) + _without(data, _HIGH)  # code points, taken for letters
    return (len(words), len(text) - _without(data, _SPACE), _without(data, SYMBOLS), again, lines, len(set(words)), upper,
            upper + lower + beyond_ascii, data.count(b"|") + data.count(b"\t"))


def repeated_words(codes: list[np.ndarray], window: int = 3) -> np.ndarray:
    """Of each text, the words in windows of ``window`` words that the text holds twice or more."""
    sizes = np.array([len(c) for c in codes])
    joined = np.concatenate([*codes, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(codes)), sizes)
    out = np.zeros(len(codes), np.int64)
    if len(joined) < window:
        return out
    first = np.flatnonzero(owner[: len(joined) - window + 1] == owner[window - 1 :])
    if not len(first):
        return out
    key = anchors.ranges_hash(anchors.prefix_sums(joined, 0), 0, first, first + window)
    key ^= anchors.mixed(owner[first].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(joined) + 1, np.int32)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + window, -1)
    return np.bincount(owner, np.cumsum(step[:-1]) > 0, len(codes)).astype(np.int64)


def _measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows, repeats, held, size = [], [], [], 0
        for text in texts:
            text = text or ""
            data = text.encode()
            words = data.split()
            rows.append(_plain_metrics(text, data, words))
            held.append(word_codes(data))
            size += len(words)
            if size > 500_000:
                repeats.append(repeated_words(held))
                held, size = [], 0
        repeats.append(repeated_words(held))
        frame = pd.DataFrame(rows, columns=[m for m in METRICS if m != "n_repeat_words"])
        yield frame.assign(n_repeat_words=np.concatenate(repeats))[list(METRICS)]


def metrics(text: Column) -> Column:
    """A struct of the figures that the rules look at; null texts have none of anything."""
    return F.pandas_udf(_measure, ", ".join(f"{name} long" for name in METRICS))(text)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.when(F.col(whole) > 0, F.col(whole))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 for no opinion.

    Distinct words grow more slowly than words, so the least number of them follows a share in short
    texts and a power of the length in long ones; the two meet at 5,000 words.
    """
    symbols, again = _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeat, length = _share("n_repeat_words", "n_words"), _share("word_chars", "n_words")
    upper, letters, fresh = _share("n_upper", "n_letters"), _share("n_letters", "word_chars"), _share("n_distinct", "n_words")
    bars = _share("n_bars", "n_words")
    return {
        "symbols": _vote(symbols, symbols < 0.02, symbols > 0.2),
        "lines": _vote(again, (again == 0) & (F.col("n_lines") >= 3), again > 0.3),
        "repeats": _vote(repeat, repeat < 0.05, repeat > 0.3),
        "length": _vote(length, length.between(3.5, 7.5), ~length.between(2.5, 12)),
        "shouting": _vote(upper, upper < 0.15, upper > 0.5),
        "letters": _vote(letters, letters > 0.92, letters < 0.8),
        "tables": _vote(bars, bars < 0.01, bars > 0.1),
        "variety": _vote(fresh, fresh > 0.35, F.col("n_distinct") < F.least(0.15 * F.col("n_words"), 4.53 * F.pow("n_words", 0.6))),
        "brevity": _vote(F.col("n_words"), F.col("n_words") >= 100, F.col("n_words") < 20),
    }


@dataclass
class Posterior:
    names: list[str]
    probability: dict[tuple[int, ...], float]
    chances: np.ndarray  # rule x class (bad, good) x vote (-1, 0, 1)


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> Posterior:
    """Estimate the rules' accuracies from the counts of vote patterns, starting from the majority."""
    votes = np.array([p for p, _ in patterns], int).reshape(-1, len(names))
    count = np.array([n for _, n in patterns], float)
    lean = votes.sum(axis=1)
    good = np.where((votes < 0).sum(axis=1) > 0, 0.2, np.where(lean > 0, 0.9, 0.5))
    chances = np.full((len(names), 2, 3), 1 / 3)
    for _ in range(rounds if len(votes) else 0):
        weight = np.stack([count * (1 - good), count * good])
        prior = np.clip(weight.sum(axis=1) / count.sum(), 0.01, 0.99)
        for vote in (-1, 0, 1):
            chances[:, :, vote + 1] = (weight @ (votes == vote)).T + 1
        chances /= chances.sum(axis=2, keepdims=True)
        rule = np.arange(len(names))
        odds = np.log(prior[1] / prior[0]) + (np.log(chances[rule, 1, votes + 1]) - np.log(chances[rule, 0, votes + 1])).sum(axis=1)
        before, good = good, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(before - good).max() < 1e-9:
            break
    return Posterior(names, {tuple(v): float(g) for v, g in zip(votes.tolist(), good, strict=True)}, chances)


def judge(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with metrics, votes, ``base_failed``, ``probability`` and ``kept``.

    ``base_failed`` is true for under 50 words, or over half of the words in repeated 3-word
    windows; such rows are not kept, whatever the posterior. A null or empty text has zero of
    everything, and fails. Repeated rows are judged alike. An empty table gives an empty result.
    Columns of ``docs`` with the names of results are replaced.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    votes = rules()
    results = [*METRICS, "base_failed", "probability", "kept", *[f"vote_{name}" for name in votes]]
    measured = docs.drop(*results).withColumn("_metrics", metrics(F.col("text"))).select("*", "_metrics.*").drop("_metrics")
    measured = measured.withColumns({f"vote_{name}": vote for name, vote in votes.items()})
    table = staged(measured, "metrics")
    columns = [f"vote_{name}" for name in votes]
    patterns = [(tuple(row[:-1]), row[-1]) for row in table.groupBy(*columns).count().collect()]  # at most 3^rules rows
    model = fit(patterns, list(votes))
    rows = [(*votes_of, p) for votes_of, p in model.probability.items()]
    known = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns) + ", probability double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = table.join(F.broadcast(known), columns, "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))
