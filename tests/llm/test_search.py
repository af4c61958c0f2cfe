import numpy as np
import pytest

from turnledger.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    best = {}
    for doc, vector in rows:
        sound = doc is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if sound:
            best[doc] = min(best.get(doc, vector), vector)
    most = max(np.bincount([len(v) for v in best.values()]).argmax(), 0) if best else 0
    best = {d: np.array(v, np.float32).astype(float) for d, v in best.items() if len(v) == most}
    ids = np.array(sorted(best))
    table = np.array([best[i] for i in ids])
    out = []
    for i, doc in enumerate(ids):
        if doc % every == 0:
            score = table @ table[i] / np.linalg.norm(table, axis=1) / np.linalg.norm(table[i])
            others = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:k]
            out += [(int(doc), rank, int(ids[j]), float(score[j])) for rank, j in enumerate(others, 1)]
    return out


def run(spark, rows, every=50, k=5):
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], SCHEMA).repartition(3)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multi_index.nearest(df, every, k).collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(30, 24))
    return [(i, (centres[i % 30] + 0.25 * draw.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]


def test_recall_against_brute_force(spark, clustered):
    got, want = run(spark, clustered), brute(clustered, 50, 5)
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)


def test_recall_on_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got, want = run(spark, rows), sorted(brute(rows, 50, 5))
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)


def test_full_radius_is_exact_over_shards_and_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD", 200)
    monkeypatch.setattr(multi_index, "BLOCK", 9)
    learn = multi_index.learn
    monkeypatch.setattr(multi_index, "learn", lambda sample, k: learn(sample, k, covered=1.0).__class__(*_wide(learn(sample, k))))
    same(run(spark, clustered), sorted(brute(clustered, 50, 5)))


def _wide(codes):
    return codes.mean, codes.turn, codes.bits


def test_rows_that_take_no_part_ties_and_repeats(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(50, one), (51, one), (52, [2.0, 4.0, 6.0]), (53, [-1.0, 0.0, 1.0]), (51, one), (None, one), (54, None), (55, []), (56, [0.0, 0.0, 0.0]),
            (57, [1.0, None, 1.0]), (58, [float("nan"), 1.0, 1.0]), (59, [float("inf"), 1.0, 1.0]), (60, [1.0, 1.0]), (100, [0.0] * 3)]
    got = run(spark, rows)
    assert [g[:3] for g in got] == [(50, 1, 51), (50, 2, 52), (50, 3, 53)]


def test_many_equal_vectors(spark):
    got = run(spark, [(i, [1.0, 1.0, 0.5, 2.0]) for i in range(400)] + [(500, [1.0, -1.0, 0.0, 0.0])])
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5] and [g[2] for g in got if g[0] == 100] == [0, 1, 2, 3, 4]


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0, 0.0])]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert [g[:3] for g in run(spark, [(50, [1.0, 0.0]), (1, [0.0, 1.0])])] == [(50, 1, 1)]


def test_probing_finds_all_codes_within_the_radius():
    draw = np.random.default_rng(9)
    codes = draw.integers(0, 256, (3000, 8)).astype(np.uint8)
    index = multi_index.Index(codes)
    for radius in (0, 7, 19, 26, 64):
        for query in codes[:5]:
            query = query ^ np.uint8(1)
            want = np.flatnonzero(np.bitwise_count(query ^ codes).sum(axis=1) <= radius)
            assert index.within(query, radius).tolist() == want.tolist()
