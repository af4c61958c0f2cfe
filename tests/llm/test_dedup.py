import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnledger.llm import anchors, components, prefix_free_parsing, repeats, simhash, suffix_trees


@pytest.fixture(scope="module")
def docs(spark):
    rows = brute.corpus()
    return rows, spark.createDataFrame([(*r, 1, "clash") for r in rows], brute.SCHEMA + ", _doc_key int, kept string").repartition(3)


def test_prefix_free_parsing_equals_brute_force(docs):
    rows, df = docs
    got = prefix_free_parsing.dedup_substrings(df)
    assert brute.ordered(map(tuple, got.drop("kept").collect())) == brute.ordered(brute.prefix_free(rows))


def test_passages_equal_brute_force(docs):
    rows, df = docs
    got = suffix_trees.dedup_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert brute.ordered(map(tuple, got.collect())) == brute.ordered(r[:4] for r in brute.passages(rows))


def test_passages_keep_columns_and_untouched_texts(docs):
    rows, df = docs
    out = suffix_trees.dedup_passages(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_sha256", "kept"]
    for row in out.collect():
        assert row["n_removed"] > 0 or row["kept"] == row["text"]


@pytest.mark.parametrize("large", [1, 3])
def test_lengthened_keys_give_the_same(docs, large, monkeypatch):
    """Anchors with more spans than a task should hold take the other way."""
    rows, df = docs
    monkeypatch.setattr(repeats.Windows, "__init__", _with(repeats.Windows.__init__, group_rows=large, longest=16, chunk=700))
    got = prefix_free_parsing.dedup_substrings(df).drop("kept")
    assert brute.ordered(map(tuple, got.collect())) == brute.ordered(brute.prefix_free(rows))
    got = suffix_trees.dedup_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert brute.ordered(map(tuple, got.collect())) == brute.ordered(r[:4] for r in brute.passages(rows))


def _with(init, **more):
    return lambda self, *args, **named: init(self, *args, **{**named, **more})


def test_each_window_lies_in_one_span_and_copies_share_them():
    codes = anchors.BYTE_CODES[np.random.default_rng(1).integers(0, 4, 3000)]
    found = anchors.spans(np.concatenate([codes, codes[500:]]), np.array([3000, 5500]), 40, 8, 512)
    places = np.concatenate([np.arange(f, f + c) for f, c in zip(found.first, found.count, strict=True)])
    assert sorted(places) == [*range(3000 - 39), *range(3000, 5500 - 39)]
    whole = np.concatenate([codes, codes[500:]])
    keys = [(a, whole[f : f + c + 39].tobytes()) for a, f, c in zip(found.anchor.tolist(), found.first, found.count, strict=True)]
    one = {k for k, f in zip(keys, found.first, strict=True) if 600 <= f < 3000 - 40}
    two = {k for k, f in zip(keys, found.first, strict=True) if f >= 3000}
    assert len(one - two) <= 2


def test_fingerprints_and_classes_equal_brute_force(docs):
    rows, df = docs
    got = simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    prints = [brute.fingerprint(text) for _, text, *_ in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute.near([r[0] for r in rows], prints), strict=True)]
    assert brute.ordered(map(tuple, got)) == brute.ordered(want)


@pytest.mark.parametrize("heavy", [60_000, 40])
def test_shards_lose_no_link(spark, heavy, monkeypatch):
    """Clouds of near fingerprints over many small shards, and shards split into pairs of parts."""
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**63, 60, np.uint64)
    prints = np.unique(np.concatenate([c ^ (np.uint64(1) << draw.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 30).astype(np.uint64)) for c in centres] + [draw.integers(0, 2**63, 1500, np.uint64)]))
    tree = simhash.fit(np.sort(prints), 1, 3, shard=100, heavy=heavy)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(3)
    star = {r["a"]: r["b"] for r in components.stars(simhash._search(df, tree, 3)).collect()}
    labels = simhash.classes(prints, 3, block=10**6)
    groups = {}
    for value, label in zip(prints.view(np.int64).tolist(), labels.tolist(), strict=True):
        groups.setdefault(label, []).append(value)
    for members in groups.values():
        assert {star.get(m, m) for m in members} == {min(members)}


def test_one_of_each_keeps_the_smallest_id(docs):
    rows, df = docs
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    prints = [brute.fingerprint(text) for _, text, *_ in rows]
    classes = set(brute.near(list(range(len(rows))), prints))
    assert kept.count() == len(classes)
    found = {r["doc_id"] for r in kept.collect()}
    assert {c for c in brute.near([r[0] for r in rows], prints) if c is not None} <= found


def test_chains_end_in_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (5, 5), (300, 299)]
    star = components.stars(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["a"], r["b"]) for r in star.collect()} == {(i, 0) for i in range(1, 41)} | {(200, 100), (300, 299)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    for out in (prefix_free_parsing.dedup_substrings(none), suffix_trees.dedup_passages(none), simhash.near_duplicates(none), simhash.one_of_each(none)):
        assert out.isEmpty()
    assert components.stars(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_all_texts_alike(spark):
    df = spark.range(300).select("id", F.lit("one two three " * 40).alias("text")).withColumnRenamed("id", "doc_id")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0}
    assert {(r["doc_id"] == 0, r["n_removed"]) for r in suffix_trees.dedup_passages(df).collect()} == {(True, 0), (False, 120)}


def test_hashes_that_meet_join_no_different_texts(spark):
    """Polynomial hashes of these texts agree, their windows do not."""
    rows = [(i, t, None, None, 0) for i, t in enumerate(brute.thue_morse())]
    of_bytes, of_words = spark.createDataFrame(rows[:2], brute.SCHEMA), spark.createDataFrame(rows[2:], brute.SCHEMA)
    assert {r["n_removed"] for r in prefix_free_parsing.dedup_substrings(of_bytes).collect()} == {0}
    assert {r["n_removed"] for r in suffix_trees.dedup_passages(of_words).collect()} == {0}
