"""Cut sequences of symbols into anchored spans, so that equal windows meet under one key.

A rolling hash gives each gram of ``gram`` symbols a value. The anchor of a window is the smallest
value among its grams, so equal windows have equal anchors wherever they stand. Neighbouring
windows with one anchor form a span; each window lies in exactly one span. A corpus of n symbols
has about 2 n / (window - gram + 2) spans, which is what is shuffled instead of n windows.

The rolling hash only brings windows together: it is a polynomial modulo 2^64, which some
different sequences share, so no two windows or spans are taken for equal by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
#: A code of each byte value, far apart from each other.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, np.uint64, endpoint=True)

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2^64, kept for the next call."""
    if not _powers or len(_powers[0][0]) < length:
        _powers.clear()
        size = max(length, 1 << 16)
        for base in _BASES:
            both = []
            for factor in (base, pow(base, -1, 1 << 64)):
                run = np.full(size, factor, np.uint64)
                run[0] = 1
                both.append(np.multiply.accumulate(run))
            _powers.append((both[0], both[1]))
    return _powers


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits; different values stay different."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(32))
    return values * _MIX[1]


def prefix_sums(codes: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes) + 1)[which][0][: len(codes)], out=sums[1:])
    return sums


def ranges_hash(sums: np.ndarray, which: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [first, last)."""
    return mixed((sums[last] - sums[first]) * powers(len(sums))[which][1][first])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours, in log2(width) passes."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass(frozen=True)
class Spans:
    first: np.ndarray  # place of the first window in the symbols
    count: np.ndarray  # windows
    anchor: np.ndarray
    inner: np.ndarray  # may hold its anchor twice, so windows of it may equal each other


def spans(codes: np.ndarray, ends: np.ndarray, window: int, gram: int, longest: int) -> Spans | None:
    """Anchored spans of sequences that lie one after the other in ``codes`` and end at ``ends``."""
    size = len(codes)
    if size < window:
        return None
    grams, width = size - gram + 1, window - gram + 1
    sums = prefix_sums(codes, 0)
    inverse = powers(size + 1)[0][1]
    value = mixed((sums[gram:] - sums[:-gram]) * inverse[:grams])
    least = sliding(value, width, np.minimum)
    crossing = np.zeros(size + 1, np.int32)
    np.add.at(crossing, np.maximum(ends - window + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    whole = np.cumsum(crossing)[: size - window + 1] == 0
    at = np.flatnonzero(whole)
    if not len(at):
        return None
    own = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(at)))
    if count.max() > longest:
        pieces = -(-count // longest)
        begin = np.repeat(begin, pieces) + longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        count = np.diff(np.append(begin, len(at)))
    first, anchor = at[begin], own[begin]
    # Anchor places: grams that are the smallest of some whole window.
    padded = np.zeros(size - window + 1 + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, 0)
    place = np.flatnonzero(value == sliding(padded, width, np.maximum))
    order = np.lexsort((place, value[place]))
    ranked, place = value[place][order], place[order]
    close = (ranked[1:] == ranked[:-1]) & (np.diff(place) < int(count.max()) + width)
    inner = np.isin(anchor, ranked[1:][close])
    return Spans(first, count, anchor, inner)
