import math
from collections import Counter

import numpy as np
import pytest

from turnledger.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, components=32):
    """Exact integers and a library's eigenvectors: {vec_id: (deviation, {component: absolute value})}, shares."""
    sound = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not sound:
        return [], []
    size = max(Counter(len(v) for _, v in sound).items(), key=lambda e: (e[1], e[0]))[0]
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in sound if len(v) == size]
    n, sums = len(x), [sum(column) for column in zip(*[v for _, v in x], strict=True)]
    off = [[n * a - s for a, s in zip(v, sums, strict=True)] for _, v in x]
    centred = np.array(off, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    rank = int((values > 1e-10 * max(values.max(), 1e-300)).sum()) if values.max() > 0 else 0
    white = centred @ axes[:, :rank] / np.sqrt(values[:rank])
    total = np.trace(centred.T @ centred / n)
    return [(i, sum(a * a for a in o), w) for (i, _), o, w in zip(x, off, white, strict=True)], values[:rank] / total if rank else []


def check(spark, rows, components=32, tolerance=1e-7):
    got = whitening.whitened_entries(table(spark, rows), components).collect()
    want, shares = brute(rows, components)
    assert len(got) == len(want) * len(shares)
    entries = lambda i, d, w, n: (str(i), d, n, round(abs(w), 5))
    plain = sorted(entries(i, d, w[k], k + 1) for i, d, w in want for k in range(len(shares)))
    found = sorted(entries(r["vec_id"], r["deviation"], r["whitened"], r["component"]) for r in got)
    assert [p[:3] for p in plain] == [f[:3] for f in found]
    assert np.allclose([p[3] for p in plain], [f[3] for f in found], atol=1e-4)
    for row in got:
        assert row["n"] == len(want) and row["identity_error"] < tolerance and abs(row["explained"] / shares[row["component"] - 1] - 1) < 1e-9
    return got


def vectors(n, size, seed):
    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(size, size)) * np.geomspace(1, 0.05, size)
    return [(i, (3 + draw.normal(size=size) @ mix).tolist()) for i in range(n)]


def test_equals_a_plain_computation(spark):
    got = check(spark, vectors(300, 24, 1))
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    white = np.array([[by[i, k] for k in range(1, 25)] for i in range(300)])
    assert np.abs(white.T @ white / 300 - np.eye(24)).max() < 1e-9
    check(spark, vectors(200, 40, 2), components=32)
    check(spark, vectors(100, 7, 3), components=3)


def test_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert len(check(spark, rows)) == 32 * len(rows)


def test_rows_that_take_no_part_repeats_and_null_ids(spark):
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [float("nan")] * 3), (5, [float("inf"), 0.0, 0.0]), (6, [1.0] * 2)]
    rows = [(10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (None, [0.0, 5.0, 1.5]), (None, [4.0, 4.0, 4.5]), (11, [-7.0, 0.25, 0.01])]
    check(spark, rows + odd)
    assert whitening.whitened(table(spark, [(1, [1e300, 1.0]), (2, [1.0, 2.0]), (3, [3.0, 2.5])]))[1].n == 2


def test_no_variance_and_low_rank(spark):
    assert whitening.whitened_entries(table(spark, [])).collect() == []
    assert whitening.whitened_entries(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whitened_entries(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    twin = [(i, [*v, v[0], 5.0]) for i, v in vectors(60, 4, 4)]
    assert len(check(spark, twin)) == 60 * 4


def test_large_entries_give_exact_deviations(spark):
    check(spark, [(i, [2.0**18 * (i % 5), -(2.0**19) + 9 * i * i]) for i in range(20)])
    got = whitening.whitened_entries(table(spark, [(i, [2.0**40 * (i % 3), 1.0 * i]) for i in range(20)])).collect()
    assert len(got) == 20 and all(r["deviation"] is None for r in got)  # beyond a long, and of rank one in double precision
    wide, _ = whitening.whitened(table(spark, [(i, [2.0**40 * (i % 3), 1.0 * i]) for i in range(20)]))
    x = [(64 * 2**40 * (i % 3), 64 * i) for i in range(20)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((20 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in wide.collect()} == want


@pytest.mark.parametrize("rank", [0, 1, 5, 8])
def test_factor_and_rotations(rank):
    draw = np.random.default_rng(rank)
    half = draw.normal(size=(8, rank)) * np.geomspace(1, 1e-5, rank)
    a = half @ half.T
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12) and np.allclose(factor, np.tril(factor))
    assert (np.diff(np.diag(factor)) <= 1e-9).all()
    values, axes = whitening.principal(a)
    assert len(values) == rank and np.allclose(axes.T @ axes, np.eye(rank), atol=1e-10)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-14) and np.allclose((axes * values) @ axes.T, a, atol=1e-12)


def test_rounds_pair_every_two_columns_once():
    for columns in (2, 3, 8, 9):
        pairs = [(a, b) for p, q in whitening._rounds(columns) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(columns) for b in range(a + 1, columns)]
