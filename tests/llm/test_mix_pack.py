import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnledger.llm import packing, raking, text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5) for r in brute.corpus()], brute.SCHEMA + ", weight double").repartition(3)


def test_words_are_counted_alike(spark, docs):
    got = docs.select("text", text.word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(brute.words(r["text"])) for r in got)


def test_margins_meet_their_targets(docs):
    cells = raking.calibrated(docs, rounds=30).toPandas()
    for name, power in raking.POWERS.items():
        tokens = cells.groupby(name)["n_tokens"].sum()
        want = np.where(tokens > 0, tokens.astype(float) ** power, 0)
        got = cells.groupby(name)["weight"].sum()
        assert np.abs(got / got.sum() - want / want.sum()).max() < 1e-3
    assert cells["probability"].max() == 1 and cells["probability"].min() >= 0


def test_shuffled_raking_gives_the_same_weights(docs, monkeypatch):
    order = list(raking.MARGINS)
    near = raking.calibrated(docs).toPandas().sort_values(order)
    monkeypatch.setattr(raking, "TOGETHER", 0)
    far = raking.calibrated(docs).toPandas().sort_values(order)
    assert np.allclose(near["weight"], far["weight"], rtol=1e-12)


def test_draws_follow_the_probability(spark):
    rows = [(i, f"w{i} " * (i % 40 + 1), "en" if i % 3 else "de", "big" if i % 4 else "small", 1) for i in range(4000)]
    drawn = raking.drawn(spark.createDataFrame(rows, brute.SCHEMA)).toPandas()
    assert len(drawn) == 4000 and (drawn["kept"] == (drawn["draw"] < drawn["probability"])).all()
    expected = (drawn["n_tokens"] * drawn["probability"]).groupby(drawn["source"]).sum()
    kept = drawn[drawn["kept"]].groupby("source")["n_tokens"].sum()
    assert np.abs(kept / kept.sum() - expected / expected.sum()).max() < 0.03


def test_mix_keeps_the_drawn_rows_whole(docs):
    out = raking.mix(docs)
    assert out.columns == docs.columns
    want = raking.drawn(docs).filter("kept").count()
    assert out.count() == want


def test_a_rare_source_does_not_set_the_size_of_the_mix(spark):
    """One document of a rare source beside a hot one: it is taken whole, and the budget is met all the same."""
    rows = [(i, f"w{i} " * 50, "en" if i % 7 else "de", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(1500)]
    docs = spark.createDataFrame([*rows, (9999, "rare " * 50, "xx", "rare", 1)], brute.SCHEMA)
    cells = raking.calibrated(docs, keep=0.6)
    got = cells.toPandas()
    assert got["probability"].between(0, 1).all() and got.loc[got["source"] == "rare", "probability"].tolist() == [1]
    assert (got["n_tokens"] * got["probability"]).sum() == pytest.approx(0.6 * got["n_tokens"].sum(), rel=1e-6)
    kept = raking.mix(docs, keep=0.6).select("doc_id").toPandas()["doc_id"]
    assert 0.5 * 1501 < len(kept) < 0.7 * 1501 and 9999 in set(kept)
    far = raking.margins(cells).toPandas().set_index(["margin", "value"])
    assert far.groupby("margin")[["target", "share"]].sum().to_numpy() == pytest.approx(1)
    rare = far.loc["source", "rare"]
    assert rare["share"] == pytest.approx(50 / (0.6 * got["n_tokens"].sum())) and rare["share"] < rare["target"]
    others = far.loc["source"].drop("rare")
    assert (others["share"] / others["target"]).to_numpy() == pytest.approx((1 - rare["share"]) / (1 - rare["target"]), abs=0.05)


def test_given_targets_are_met_within_the_tolerance(spark):
    """Half the tokens from each of two sources, two languages as given; what is not named stays out."""
    rows = [(i, f"w{i} " * 50, ("en", "de", "fr")[i % 3], ("hot", "hot", "hot", "small")[i % 4], 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    targets = {"source": {"hot": 1, "small": 1, "absent": 5}, "lang": {"en": 3, "de": 1}}
    cells = raking.calibrated(docs, rounds=60, keep=0.2, targets=targets, tolerance=1e-6)
    far = raking.margins(cells, targets=targets).toPandas().set_index(["margin", "value"])
    assert far.loc[("source", "small"), "share"] == pytest.approx(0.5, abs=1e-5) and far.loc[("lang", "en"), "share"] == pytest.approx(0.75, abs=1e-5)
    assert far.loc[("lang", "fr"), "share"] == 0 and (far["share"] - far["target"]).abs().max() < 1e-5
    assert raking.mix(docs, keep=0.2, targets=targets, tolerance=1e-6).filter("lang = 'fr'").isEmpty()
    assert raking.mix(docs, keep=0.2, targets={"source": {}}).isEmpty()


def test_a_rare_source_hardly_changes_what_the_query_draws(spark, tmp_path):
    """One document of a new source: the share of tokens kept stays, in the query and in its SQL."""
    import duckdb

    from turnledger.llm.queries import ORACLES, op7_raked_mixture

    rows = [(i, f"w{i} " * 50, "en" if i % 7 else "de", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(1500)]
    for extra in ([], [(9999, "rare " * 50, "xx", "rare", 1)]):
        folder = str(tmp_path / f"d{len(extra)}")
        spark.createDataFrame([*rows, *extra], brute.SCHEMA).write.parquet(f"{folder}/documents.parquet")
        got = op7_raked_mixture(spark, folder).toPandas()
        assert got.loc[got["kept"], "n_tokens"].sum() / got["n_tokens"].sum() == pytest.approx(2 / 3, abs=0.02)
        assert (got["n_tokens"] * got["probability"]).sum() / got["n_tokens"].sum() == pytest.approx(2 / 3, abs=1e-6)
        sql = ORACLES["op7_raked_mixture"].replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'")
        want = duckdb.sql(sql).df().sort_values("doc_id")
        assert np.allclose(got.sort_values("doc_id")["probability"], want["probability"], atol=2e-9)
        assert (got.sort_values("doc_id")["kept"].to_numpy() == want["kept"].to_numpy()).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    assert raking.drawn(none).isEmpty() and raking.mix(none).isEmpty() and packing.packed(none).isEmpty()


def test_every_token_is_packed_once(docs):
    out = packing.packed(docs, (64, 128, 512)).toPandas()
    rows = brute.corpus()
    assert out["n_tokens"].sum() == sum(len(brute.words(t)) for _, t, *_ in rows)
    assert (out["piece"] == 0).sum() == len(rows)
    assert (out["start"] == out["piece"] * 512).all()
    assert out.loc[out["bin_id"].isna(), "n_tokens"].eq(0).all() and out.loc[out["bin_id"].notna(), "n_tokens"].gt(0).all()
    for _, one in out.dropna(subset=["bin_id"]).sort_values("position").groupby("bin_id"):
        assert one["capacity"].nunique() == 1 and one["n_tokens"].sum() == one["bin_tokens"].iloc[0] <= one["capacity"].iloc[0]
        assert (one["position"].to_numpy() == np.cumsum([0, *one["n_tokens"]])[:-1]).all()
        assert not any(one["bin_tokens"].iloc[0] <= c < one["capacity"].iloc[0] for c in (64, 128, 512))


def test_best_fit_equals_a_plain_search():
    """The bin of each piece is the fullest that still has room, found here by looking at all bins."""
    draw = random.Random(3)
    for _ in range(20):
        sizes = np.array([draw.randint(1, 100) for _ in range(draw.randint(1, 80))])
        lengths = (25, 50, 100)
        bins, capacity = packing.pack(sizes, lengths)
        room, used, left = [], [], int(sizes.sum())
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in room if r >= sizes[i]]
            if fits:
                least = min(fits)
                room.remove(least)
                room.append(least - sizes[i])
            else:
                able = [c for c in lengths if c >= sizes[i]]
                room.append(min(able, key=lambda c: (packing.cost(c) / min(c, left), c)) - sizes[i])
                used.append(1)
            left -= sizes[i]
        tally = np.bincount(bins, sizes)
        assert len(tally) == len(used) and (tally <= capacity).all()


@pytest.mark.parametrize("sizes", [np.full(2000, 300), np.random.default_rng(1).integers(280, 321, 2000), np.full(7, 8192), np.zeros(0, int)])
def test_lengths_compete_for_what_fills_them(sizes):
    """Texts of like lengths go into longer bins, at less than any one length costs, plain best fit included."""
    spent = lambda capacity: sum(map(packing.cost, capacity.tolist()))
    bins, capacity = packing.pack_least(sizes)
    assert (np.bincount(bins, sizes, len(capacity)) <= capacity).all() and len(bins) == len(sizes)
    assert all(spent(capacity) <= spent(packing.pack(sizes, least=length)[1]) for length in (0, *packing.LENGTHS))
    if len(sizes) == 2000:
        single = [spent(packing.pack(sizes, (length,))[1]) for length in packing.LENGTHS]
        assert spent(capacity) < min(single) and (capacity > 512).sum() > 400
        assert spent(capacity) < 0.7 * spent(packing.pack(sizes)[1])


def test_bins_are_downsized_to_what_they_hold():
    assert packing.pack(np.full(7, 300), least=1024)[1].tolist() == [1024, 1024, 512]


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([(1, "w " * 1000, None, None, 0), (None, None, None, None, None)], brute.SCHEMA)
    out = packing.packed(df, (100, 300)).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in out] == [(None, 0, 0), (1, 0, 300), (1, 300, 300), (1, 600, 300), (1, 900, 100)]
    assert [r["capacity"] for r in out] == [None, 300, 300, 300, 100]
