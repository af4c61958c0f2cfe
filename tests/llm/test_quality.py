import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnledger.llm import factor_quality as quality

LABELS = "doc_id long, quality int, toxic int"


def test_linear_time_score_equals_the_sum_over_pairs():
    draw = np.random.default_rng(3)
    machine = quality.Machine(0.3, draw.normal(size=quality.ENTRIES), draw.normal(size=(quality.ENTRIES, quality.FACTORS)))
    rows = quality.rows_of(["a b c a b", "", None, "one TWO three ### | 77", "x"], [9, 0, None, -4, float("nan")])
    for r, got in enumerate(machine.parts(rows)[0]):
        at, value = (part[rows.starts[r] : rows.starts[r + 1]] for part in (rows.at, rows.value))
        want = 0.3 + sum(machine.weight[i] * x for i, x in zip(at, value, strict=True))
        for p in range(len(at)):
            for q in range(p):
                want += (machine.factor[at[p]] @ machine.factor[at[q]]) * value[p] * value[q]
        assert got == pytest.approx(want, rel=1e-5)


def test_pairs_matter():
    """Good is one of two words without the other: no sum of single weights says so."""
    texts = [" ".join(["left"] * a + ["right"] * b) for a in (0, 1) for b in (0, 1) for _ in range(80)]
    good = np.array([a != b for a in (0, 1) for b in (0, 1) for _ in range(80)]).astype(int)
    rows = quality.rows_of(texts, [5.0] * len(texts))
    only_words = np.flatnonzero(rows.at < 1 << quality.WORD_BITS)
    size = np.bincount(np.searchsorted(rows.starts, only_words, side="right") - 1, minlength=len(texts))
    keep = np.sort(np.concatenate([only_words, rows.starts[1:] - 1]))  # with one constant entry, so that no row is empty
    words = quality.Rows(np.concatenate([[0], np.cumsum(size + 1)]), rows.at[keep], np.ones(len(keep), np.float32))
    machine = quality.fit(words, good, rounds=60)
    assert ((machine.scores(words) > 0.5) == good).mean() == 1


def test_held_out_accuracy_and_registered_query(spark):
    from turnledger.llm import queries

    folder = "/root/testdata/sf0.01"
    out = queries.op12_factorisation_machine(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = ([r["score"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_awkward_rows_repeats_and_clashing_columns(spark):
    rows = brute.corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], brute.SCHEMA + ", score string, quality int")
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") > 500), 0) for r in rows] + [(None, 1, 0), (3, None, 1)], LABELS)
    machine = quality.train(df, labels)
    out = quality.with_quality(df, machine).collect()
    assert brute.ordered([r[:5] for r in out]) == brute.ordered([tuple(r) for r in rows])
    assert all(0 <= r["score"] <= 1 for r in out) and {r["quality"] for r in out} == {1}
    scores = {}
    for r in out:
        assert scores.setdefault((r["text"], r["n_chars"]), r["score"]) == r["score"]
    again = {r["doc_id"]: r["score"] for r in quality.with_quality(df.repartition(5), quality.train(df.repartition(5), labels)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 0.2 for r in out if sum(x["doc_id"] == r["doc_id"] for x in out) == 1)


def test_only_learned_rows_are_learned_from(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(7, 0, 0), (8, 0, 0), (9, 5, 0), (None, 1, 0)], LABELS)
    known = {r["doc_id"]: r["good"] for r in quality.labelled(labels).collect()}
    kept = [r[0] for r in spark.range(40).filter(~quality.held_out(F.col("id"))).collect()]
    assert known == {i: i % 2 for i in kept if i != 7}
    docs = spark.createDataFrame([(i % 40, f"text {i}", None, None, i) for i in range(200)], brute.SCHEMA)
    assert sorted(r["doc_id"] for r in quality.sampled(docs, labels).collect()) == sorted(known)


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    some = spark.createDataFrame([(1, "some words", None, None, None), (2, None, None, None, 0)], brute.SCHEMA)
    no_labels, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert quality.with_quality(none, quality.train(none, no_labels)).collect() == []
    for labels, score in ((no_labels, 0.5), (one, 0.5)):
        found = quality.with_quality(some, quality.train(some, labels)).collect()
        assert len({r["score"] for r in found}) == 1 and found[0]["score"] >= score
