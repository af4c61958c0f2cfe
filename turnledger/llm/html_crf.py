"""Main-text extraction with a linear-chain conditional random field over the leaf blocks of a page.

Blocks are labelled main text or not. A block's features are its ancestors' tags and names and the
shape of its text; the chain's transitions carry the label on from block to block. Weights are
trained on labelled pages by gradient ascent with forward-backward sums, pages are decoded by
Viterbi. Pages are independent rows, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.html_blocks import Block, blocks
from turnledger.llm.labelled_pages import labelled_pages
from turnledger.llm.text import bound_batches

_HINTS = ("cookie", "subscribe", "newsletter", "copyright", "©", "rights reserved", "sign up", "privacy", "share", "comment", "reply", "advert")
HINTED = 25  # words of a block to each mention of a hint, at most


#: Tags that say what the text in them is; text in none of them, and in nothing named, stands loose.
_TELLING = frozenset("article main section nav header footer aside form blockquote figure".split())
#: Names that pages give to the element around their article.
_FRAMES = frozenset("content article post story entry main".split())


def framed(path: tuple[str, ...]) -> bool:
    """Whether a block stands in an element that pages use for their article."""
    steps = [step.split(".") for step in path]
    return any(tag in ("article", "main") or not _FRAMES.isdisjoint(names) for tag, *names in steps)


def path_features(path: tuple[str, ...], beside: bool = False) -> list[str]:
    """Of a block's ancestors: each tag and name, tags in pairs from the outside in, and the parent's.

    ``beside`` says that other blocks of the page are framed and this one is not.
    """
    steps = [step.split(".") for step in path]
    tags = [tag for tag, *_ in steps]
    found = {"bias", *(f"in {tag}" for tag in tags), *(f"named {name}" for _, *names in steps for name in names)}
    found.update(f"{outer} > {inner}" for outer, inner in zip(tags, tags[1:], strict=False))
    if path:
        found.add(f"parent {tags[-1]}")
    if _TELLING.isdisjoint(tags) and not any(names for _, *names in steps):
        found.add("in nothing")
    if beside:
        found.add("beside the frame")
    return sorted(found)


def page_paths(found: list[Block]) -> list[tuple[tuple[str, ...], bool]]:
    """The arguments of ``path_features`` for each block of a page."""
    inside = [framed(b.path) for b in found]
    some = any(inside)
    return [(b.path, some and not own) for b, own in zip(found, inside, strict=True)]


def text_features(block: Block) -> list[str]:
    """The shape of a block's text."""
    text = block.text
    words = text.count(" ") + 1
    found = [f"words {min(words.bit_length(), 6)}", f"linked {min(4, 4 * block.linked // max(1, len(text)))}"]
    if text[-1] in ".!?…。":
        found.append("ends a sentence")
    found.append(f"commas {min(text.count(','), 2)}")
    low = text.lower()
    said = {hint: low.count(hint) for hint in _HINTS}
    # A word of a notice counts by how often it comes in the whole block: an article may mention it.
    found += [f"says {hint}" for hint, times in said.items() if times * HINTED >= words]
    found.append(f"hints {min(3, 3 * HINTED * sum(said.values()) // (4 * words))}")
    return found


@dataclass
class Model:
    weight: dict[str, float]  # for main text, against none
    start: float  # for main text in the first block
    move: tuple[tuple[float, float], tuple[float, float]]  # from label, to label


def _padded(pages: list[list[Block]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Feature names, a page x place x feature table, labels and a mask."""
    each = [[path_features(*at) + text_features(b) for b, at in zip(page, page_paths(page), strict=True)] for page in pages]
    names = sorted({name for page in each for found in page for name in found})
    number = {name: i for i, name in enumerate(names)}
    longest = max(len(page) for page in pages)
    table = np.zeros((len(pages), longest, len(names)), np.float32)
    label, live = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, page in enumerate(pages):
        for t, block in enumerate(page):
            table[i, t, [number[name] for name in each[i][t]]] = 1
            label[i, t], live[i, t] = block.main, True
    return names, table, label, live


def train(pages: list[str] | None = None, rounds: int = 250, ridge: float = 0.004) -> Model:
    """Fit on pages whose main elements carry ``data-main``; by default those of ``labelled_pages``."""
    names, table, label, live = _padded([b for b in map(blocks, labelled_pages() if pages is None else pages) if b])
    n, longest, size = table.shape
    row = np.arange(n)
    weight, move, start = np.zeros(size), np.zeros((2, 2)), 0.0
    speed = [np.zeros(size), np.zeros((2, 2)), 0.0]
    power = [np.zeros(size), np.zeros((2, 2)), 0.0]
    pairs = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:, :-1][pairs], label[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        own = np.zeros((n, longest, 2))
        own[:, :, 1] = table @ weight
        ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = own[:, 0] + [0, start]
        for t in range(1, longest):
            reach = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + own[:, t]
            ahead[:, t] = np.where(live[:, t, None], reach, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            reach = np.logaddexp.reduce(move + (own[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(live[:, t + 1, None], reach, 0)
        total = np.logaddexp.reduce(ahead[row, -1], axis=1)
        chance = np.exp(ahead + back - total[:, None, None])[:, :, 1] * live
        both = np.exp(ahead[:, :-1, :, None] + move + (own[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
        miss = label * live - chance
        slope = [
            np.tensordot(miss, table, 2) / n - ridge * weight / 10,
            (seen - (both * pairs[:, :, None, None]).sum(axis=(0, 1))) / n - ridge * move / 10,
            (label[:, 0] - chance[:, 0]).mean() - ridge * start / 10,
        ]
        values = [weight, move, start]
        for i in range(3):
            speed[i] = 0.9 * speed[i] + 0.1 * slope[i]
            power[i] = 0.999 * power[i] + 0.001 * slope[i] ** 2
            values[i] = values[i] + 0.1 * (speed[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
        weight, move, start = values
    return Model(dict(zip(names, map(float, weight), strict=True)), float(start), tuple(map(tuple, move.tolist())))


def decode(found: list[Block], model: Model, known: dict[tuple, float]) -> list[bool]:
    """Viterbi labels of a page's blocks; ``known`` remembers the scores of ancestor paths."""
    get = model.weight.get
    steps: list[tuple[bool, bool]] = []
    (stay0, to1), (to0, stay1) = model.move
    none = main = 0.0
    for i, (block, at) in enumerate(zip(found, page_paths(found), strict=True)):
        if (score := known.get(at)) is None:
            score = known[at] = sum(get(name, 0.0) for name in path_features(*at))
        score += sum(get(name, 0.0) for name in text_features(block))
        if i == 0:
            none, main = 0.0, score + model.start
            continue
        a, b, c, d = none + stay0, main + to0, none + to1, main + stay1
        steps.append((b > a, d >= c))
        none, main = max(a, b), max(c, d) + score
    label = main > none
    out = [label]
    for from_main_0, from_main_1 in reversed(steps):
        label = from_main_1 if label else from_main_0
        out.append(label)
    return out[::-1][: len(found)]


def main_text(page: str | None, model: Model, known: dict[tuple, float]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, decode(found, model, known), strict=True) if keep)


def extract(html: Column, model: Model) -> Column:
    """The main text of each page: its main blocks in page order, joined by an empty line.

    White space inside a block is one space; a null or empty page, or one without main blocks,
    gives the empty string. Equal pages give equal texts, broken markup is read as far as it goes.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[tuple, float] = {}
        for pages in batches:
            yield pages.map(lambda page: main_text(page, model, known))

    return texts(html)


def with_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to the rows of ``pages``, replacing columns of those names."""
    bound_batches(pages)
    found = pages.withColumn("text", extract(F.col("html"), model or train()))
    return found.withColumn("n_chars", F.length("text").cast("long"))
