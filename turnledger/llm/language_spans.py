"""Language identification: script ranges narrow the candidates, Viterbi labels spans of words.

Each word gets a log-likelihood per language from hashed letter trigrams; languages not written in
the word's script are out. Along a text, Viterbi picks one language per word at a penalty for each
switch, so mixed-language texts fall into spans. Texts are decoded side by side: step t handles
word t of all texts of a batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.text import bound_batches, text_bytes

#: First and last code point of the scripts told apart (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
N_SCRIPTS = 32  # number 0 is any other script
NONE = "und"
BUCKETS = 1 << 16
_CUT = 400_000  # code points scored at once
_WORDS = 600_000  # words decoded at once


def code_point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and the number of its script."""
    letter = np.zeros(0x110000, bool)
    for code in range(0x110000):
        letter[code] = unicodedata.category(chr(code))[0] == "L"
    names = list(dict.fromkeys(name for name, _, _ in SCRIPTS))
    script = np.zeros(0x110000, np.uint8)
    for name, low, high in SCRIPTS:
        script[low : high + 1] = names.index(name) + 1
    return letter, script


@dataclass
class Words:
    """Words of a batch of texts: runs of letters, with their trigrams."""

    gram: np.ndarray  # bucket at each place
    counts: np.ndarray  # whether the place's trigram belongs to a word
    first: np.ndarray  # places of first letters
    stop: np.ndarray  # places after last letters
    script: np.ndarray  # script of first letters


def words_of(text: str, letter: np.ndarray, scripts: np.ndarray) -> Words | None:
    """Letter trigrams with word boundaries; the text is lower-cased one code point at a time."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = letter[codes]
    if not inside.any():
        return None
    # A space on both sides lets each word end at a boundary.
    codes = np.concatenate([[0], np.where(inside, codes, 0), [0]]).astype(np.uint32)
    inside = codes != 0
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint32)
    two = np.where(before == 0, 0, np.concatenate([[0], before[:-1]])).astype(np.uint32)  # trigrams stay in their word
    mix = (two * np.uint32(0x85EBCA6B)) ^ (before * np.uint32(0xC2B2AE35)) ^ (codes * np.uint32(0x27D4EB2F))
    mix ^= mix >> np.uint32(15)
    mix *= np.uint32(0x2C1B3C6D)
    edge = np.diff(inside.astype(np.int8))
    first, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    counts = inside.copy()
    counts[stop] = True
    return Words(mix >> np.uint32(16), counts, first, stop, scripts[codes[first]])


def _lower(text: str) -> str:
    """Lower case that keeps the number of code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text and their places, cut between words where there is a space to cut at."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + _CUT)
        if stop < len(text) and (space := max(text.rfind(" ", start, stop), text.rfind("\n", start, stop))) > start:
            stop = space + 1
        yield start, text[start:stop]
        start = stop


def _count_rows(letter: np.ndarray, scripts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per language: trigram counts (kind 0) and letters by script (kind 1) of a whole partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                for _, part in _parts(_lower(data.decode())):
                    if (found := words_of(part, letter, scripts)) is None:
                        continue
                    own = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(found.gram[found.counts], minlength=BUCKETS)
                    by = letters.setdefault(lang, np.zeros(N_SCRIPTS, np.int64))
                    by += np.bincount(found.script, found.stop - found.first, N_SCRIPTS).astype(np.int64)
        for kind, tables in enumerate((grams, letters)):
            for lang, table in tables.items():
                at = np.flatnonzero(table)
                columns = [pa.array([lang] * len(at)), pa.array(np.full(len(at), kind)), pa.array(at), pa.array(table[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "bucket", "n"])

    return rows


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # bucket x language: log-likelihood
    script: np.ndarray  # script x language: penalty of a word in that script
    letter: np.ndarray
    scripts: np.ndarray
    learned: np.ndarray  # scripts that some language uses


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of ``docs`` that have a language and a text.

    The model's size is fixed: a table of 65,536 trigram buckets per language. Counts are summed up
    per partition and then by Spark, so no text and no open-ended vocabulary reaches the driver.
    """
    bound_batches(docs)
    letter, scripts = code_point_tables()
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    counted = labelled.mapInArrow(_count_rows(letter, scripts), "lang string, kind long, bucket long, n long")
    rows = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(rows["lang"].unique())
    number = rows["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(int)
    kind, bucket, n = (rows[c].to_numpy() for c in ("kind", "bucket", "n"))
    grams, letters = np.zeros((BUCKETS, len(languages))), np.zeros((N_SCRIPTS, len(languages)))
    for table, which in ((grams, 0), (letters, 1)):
        table[bucket[kind == which], number[kind == which]] = n[kind == which]
    score = np.log((grams + 0.3) / (grams.sum(axis=0) + 0.3 * BUCKETS)) if languages else grams
    uses = letters >= 0.01 * letters.sum(axis=0)
    known = uses.any(axis=1, keepdims=True)
    return Model(languages, score.astype(np.float32), np.where(uses | ~known, 0, -1e6).astype(np.float32), letter, scripts, known[:, 0])


def with_unlearned(model: Model) -> Model:
    """The model with ``und`` as one more language: that of the words in scripts that no learned language uses.

    Without it such words go to some learned language, as nothing tells them apart.
    """
    if not model.languages:
        return model
    score = np.concatenate([model.score, np.zeros((BUCKETS, 1), np.float32)], axis=1)
    script = np.concatenate([np.where(model.learned[:, None], model.script, -1e6), np.where(model.learned, -1e6, 0)[:, None]], axis=1)
    return replace(model, languages=[*model.languages, NONE], score=score, script=script.astype(np.float32))


def _word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x languages) scores, first letters and lengths of the words of a text."""
    scores, first, length = [], [], []
    for offset, part in _parts(_lower(text)):
        if (found := words_of(part, model.letter, model.scripts)) is None:
            continue
        each = np.where(found.counts[:, None], model.score[found.gram], 0)
        scores.append(np.add.reduceat(each, found.first, axis=0) + model.script[found.script])
        first.append(found.first - 1 + offset)
        length.append(found.stop - found.first)
    if not scores:
        return np.zeros((0, len(model.languages)), np.float32), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(scores), np.concatenate(first), np.concatenate(length)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language number of each word of each text: total score less ``penalty`` per switch.

    A tie goes to the smaller number, and to no switch.
    """
    order = np.argsort([-len(s) for s in scores], kind="stable")
    sizes = np.array([len(scores[i]) for i in order])
    table = np.concatenate([scores[i] for i in order])
    offset = np.cumsum(sizes) - sizes
    stays = np.ones(table.shape, bool)
    leader = np.zeros(len(table), np.int16)
    best = np.zeros((len(sizes), table.shape[1]), np.float64)
    live = np.searchsorted(-sizes, -np.arange(1, sizes.max() + 1), side="right") if len(sizes) else []
    for step, count in enumerate(live):
        at = offset[:count] + step
        if step:
            so_far = best[:count]
            top = so_far.argmax(axis=1)
            leader[at] = top
            switched = so_far[np.arange(count), top][:, None] - penalty
            stays[at] = so_far >= switched
            np.maximum(so_far, switched, out=so_far)
            so_far += table[at]
        else:
            best[:count] = table[at]
    path = np.zeros(len(table), np.int16)
    now = best.argmax(axis=1)
    for step in range(len(live) - 1, -1, -1):
        count = live[step]
        at = offset[:count] + step
        path[at] = now[:count]
        if step:
            now[:count] = np.where(stays[at, now[:count]], now[:count], leader[at])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    for i, start, size in zip(order, offset, sizes, strict=True):
        out[i] = path[start : start + size]
    return out


def _label(path: np.ndarray, first: np.ndarray, length: np.ndarray, languages: list[str]) -> tuple[str, float, list]:
    if not len(path) or not languages:
        return NONE, 0.0, []
    letters = np.bincount(path, length, len(languages))
    begin = np.flatnonzero(np.diff(path, prepend=-1))
    end = np.append(begin[1:], len(path)) - 1
    spans = [(languages[path[b]], int(first[b]), int(first[e] + length[e])) for b, e in zip(begin, end, strict=True)]
    return languages[letters.argmax()], float(letters.max() / letters.sum()), spans


RESULT = "lang string, score double, spans array<struct<lang: string, start: int, stop: int>>"


def identify(text: Column, model: Model, penalty: float = 12.0) -> Column:
    """A struct per text: its main language, that language's share of the letters, and the spans.

    ``spans`` hold code-point places from a span's first letter to its last. A text that is null or
    has no letters, and any text if nothing was learned, is ``und`` with score 0 and no spans.
    Equal shares go to the first language by name.
    """

    @F.pandas_udf(RESULT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list[tuple[str, float, list]] = []
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for text in texts:
                held.append(_word_scores(text or "", model))
                size += len(held[-1][0])
                if size > _WORDS:
                    rows += decode(held)
                    held, size = [], 0
            rows += decode(held)
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])

    def decode(held: list) -> list[tuple[str, float, list]]:
        paths = viterbi([h[0] for h in held], penalty) if held and model.languages else [np.zeros(0, int)] * len(held)
        return [_label(p, first, length, model.languages) for p, (_, first, length) in zip(paths, held, strict=True)]

    # Else a filter on the result would run the function twice.
    return label.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id's text modulo 3 is 1; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_on_rest(docs: DataFrame) -> Model:
    """Learn from all documents with an id and a language that are not held out."""
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``language`` (see ``identify``) to the rows of ``docs``, replacing a column of that name."""
    bound_batches(docs)
    return docs.withColumn("language", identify(F.col("text"), model))
