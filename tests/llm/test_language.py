import itertools

import numpy as np
import pytest

from tests.llm import brute
from turnledger.llm import language_spans as ls

EN = "the river and the stone with this letter from that window where they were".split()
DE = "der fluss und die brücke mit diesem brief von jenem fenster wo sie waren".split()
RU = "река и камень с этим письмом из того окна где они были".split()


@pytest.fixture(scope="module")
def model(spark):
    draw = np.random.default_rng(2)
    rows = [(" ".join(draw.choice(w, 40)), name) for w, name in ((EN, "en"), (DE, "de"), (RU, "ru")) for _ in range(30)]
    return ls.train(spark.createDataFrame([*rows, (None, "en"), ("no language", None), ("", "de")], "text string, lang string"))


def found(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["language"] for r in ls.with_language(df, model).orderBy("doc_id").collect()]


def test_pure_texts_and_edges(spark, model):
    out = found(spark, model, [" ".join(EN), " ".join(DE).upper(), "Камень!", None, "", "12 %% !", "İİ the river", "漢字"])
    assert [r["lang"] for r in out[:7]] == ["en", "de", "ru", "und", "und", "und", "en"]
    assert [r["score"] for r in out[:6]] == [1, 1, 1, 0, 0, 0] and out[3]["spans"] == []
    assert out[7]["lang"] in model.languages  # no language is known in that script, so none is out


def test_mixed_text_falls_into_spans(spark, model):
    text = " ".join(EN * 3) + " -- " + " ".join(DE * 2) + ". " + " ".join(RU)
    (one,) = found(spark, model, [text])
    assert [s["lang"] for s in one["spans"]] == ["en", "de", "ru"] and one["lang"] == "en"
    assert text[one["spans"][1]["start"] : one["spans"][1]["stop"]] == " ".join(DE * 2)
    letters = [sum(c.isalpha() for c in " ".join(w)) for w in (EN * 3, DE * 2, RU)]
    assert one["score"] == pytest.approx(letters[0] / sum(letters))


def test_script_shuts_languages_out(spark, model):
    (one,) = found(spark, model, ["the the окна the the"])
    assert [s["lang"] for s in one["spans"]] == ["en", "ru", "en"]


def test_viterbi_is_the_best_of_all_paths():
    draw = np.random.default_rng(4)
    scores = [draw.integers(-4, 5, (size, 3)).astype(np.float32) for size in (6, 1, 0, 4, 6)]

    def value(path, table):
        return sum(table[t][k] for t, k in enumerate(path)) - 2.5 * sum(a != b for a, b in itertools.pairwise(path))

    for path, table in zip(ls.viterbi(scores, 2.5), scores, strict=True):
        best = max((value(p, table) for p in itertools.product(range(3), repeat=len(table))), default=0)
        assert len(path) == len(table) and value(path, table) == pytest.approx(best)


def test_long_texts_are_scored_in_parts(spark, model, monkeypatch):
    text = " ".join(EN * 20 + DE * 15)
    whole = found(spark, model, [text])
    monkeypatch.setattr(ls, "_CUT", 50)
    scores, first, length = ls._word_scores(text, model)
    monkeypatch.undo()
    again = ls._word_scores(text, model)
    assert np.allclose(scores, again[0]) and (first == again[1]).all() and (length == again[2]).all()
    assert [s["lang"] for s in whole[0]["spans"]] == ["en", "de"]


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    model = ls.train_on_rest(empty)
    assert found(spark, model, ["the river"])[0]["lang"] == "und"
    assert ls.with_language(empty, model).isEmpty()


def test_held_out_documents_teach_nothing(spark):
    import zlib

    df = spark.createDataFrame([(i, "x", f"l{i}", None, 1) for i in range(60)] + [(None, "x", "none", None, 1)], brute.SCHEMA)
    want = {f"l{i}" for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(ls.train_on_rest(df).languages) == want


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ls.with_language(docs, ls.train_on_rest(docs)).where(ls.held_out(docs["doc_id"])).select("lang", "language.lang").collect()
    assert len(out) > 30 and sum(a == b for a, b in out) >= 0.95 * len(out)
