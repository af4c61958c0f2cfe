import hashlib
import math

import numpy as np

from turnledger.llm import simplex_clustering as clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def brute(rows, k, rounds, size):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(sound, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in sound]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(sound, found, strict=True) if m == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, m in found if m == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(sound, found, strict=True)]


def run(spark, rows, k=16, rounds=3, size=64):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in clustering.clustered(df, k, rounds, size).collect()]


def check(spark, rows, k=16, rounds=3, size=64):
    key = lambda r: (str(r[0]), r[1:])
    got, want = run(spark, rows, k, rounds, size), brute(rows, k, rounds, size)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def vectors(n, size, seed, groups=9, noise=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, size))
    return [(i * 3 - 50, (centres[i % groups] + noise * draw.normal(size=size)).tolist()) for i in range(n)]


def test_equals_comparing_all_centroids(spark):
    assert check(spark, vectors(400, 64, 1))
    check(spark, vectors(300, 64, 2, groups=300), k=40)
    check(spark, vectors(300, 5, 3), k=12, rounds=5, size=5)
    check(spark, vectors(50, 1, 4), k=7, size=1)


def test_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert len(check(spark, rows)) == len(rows)


def test_rows_that_take_no_part_ties_repeats_and_null_ids(spark):
    one, two = [0.5] * 4, [-1.0, 2.0, 0.25, 8.0]
    odd = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan")] * 4), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [1.0] * 5)]
    rows = [(10, one), (10, one), (11, one), (12, two), (None, two), (None, [3.0] * 4), (13, [0.0] * 4), (14, [-0.0] * 4), (15, [0.016] * 4)]
    assert len(check(spark, rows + odd, k=4, size=4)) == len(rows)
    check(spark, rows, k=30, size=4)
    check(spark, [(i, one) for i in range(60)], k=5, size=4)
    large = 0.9 * clustering.largest(4) / 64
    check(spark, [(1, [large] * 4), (2, [-large] * 4), (3, [1.0] * 4)], k=2, size=4)
    assert run(spark, [(1, [1e300] * 4), (2, one)], k=2, size=4) == brute([(2, one)], 2, 3, 4)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [1.0])]) == []


def test_bounds_hold_and_leave_few_centroids():
    draw = np.random.default_rng(5)
    centres = (draw.integers(-20, 20, (40, 9)) @ draw.normal(size=(9, 64))).astype(int)  # close to nine dimensions, as real ones are to few
    x = centres[draw.integers(0, 40, 2000)] + draw.integers(-6, 7, (2000, 64))
    simplex = clustering.span(centres)
    apexes, own = simplex.apexes(x), simplex.apexes(centres)
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    near = ((apexes[:, None] - own[None]) ** 2).sum(axis=2)
    turned = own * np.r_[np.ones(len(simplex.pivots) - 1), -1]
    assert (near <= far * (1 + 1e-9)).all() and (((apexes[:, None] - turned[None]) ** 2).sum(axis=2) >= far * (1 - 1e-9)).all()
    may = clustering.candidates(apexes, own)
    assert may[np.arange(2000), far.argmin(axis=1)].all() and may.mean() < 0.25


def test_pivots_on_a_line_or_at_one_point():
    line = np.outer(np.arange(8), [1, 2, 3])
    assert len(clustering.span(line).pivots) == 2 and len(clustering.span(line[:1]).pivots) == 1
    same = np.full((5, 3), 4)
    assert len(clustering.span(same).pivots) == 1 and clustering.candidates(clustering.span(same).apexes(line), clustering.span(same).apexes(same)).all()
