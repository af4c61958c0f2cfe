import numpy as np

from tests.llm import brute
from turnledger.llm import weak_rules


def test_metrics_equal_brute_force(spark):
    rows = brute.corpus() + [(9000, "a b c a b c\n\na b c a b c\nd #*|", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], brute.SCHEMA + ", n_words int")
    judged = weak_rules.judge(df)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = [(r["doc_id"], *[r[n] for n in names], r["base_failed"]) for r in judged.collect()]
    want = []
    for doc, text, *_ in rows:
        figures = brute.rule_metrics(text)
        want.append((doc, *figures, figures[0] < 50 or 100 * figures[4] > 50 * figures[0]))
    assert brute.ordered(got) == brute.ordered(want)
    assert all(not r["kept"] for r in judged.collect() if r["base_failed"])


def test_estimates_find_the_planted_accuracies():
    """Rules of known accuracy on hidden classes: the posterior finds the classes better than a majority."""
    draw = np.random.default_rng(8)
    good = draw.random(6000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.65, 0.6])
    votes = np.where(draw.random((6000, 5)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[draw.random((6000, 5)) < 0.2] = 0
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.fit([(tuple(p), int(n)) for p, n in zip(patterns.tolist(), count, strict=True)], list("abcde"))
    kept = np.array([model.probability[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (kept == good).mean() > max(0.94, ((votes.sum(axis=1) > 0) == good).mean())
    chance = model.chances[:, 1, 2] / model.chances[:, 1, [0, 2]].sum(axis=1)
    assert np.abs(chance - right).max() < 0.06


def test_junk_goes_and_prose_stays(spark):
    word = lambda n: "w" + "".join(chr(97 + n // 26**k % 26) for k in range(5))
    rows = [(i, " ".join(word(i * 31 + k * k) + ("." if k % 9 == 8 else "") for k in range(120)), None, None, 0) for i in range(200)]
    rows += [(1000 + i, " ".join(word(k) + "###" for k in range(i, i + 100)), None, None, 0) for i in range(30)]
    rows += [(2000 + i, " | ".join(word(k) for k in range(i, i + 100)), None, None, 0) for i in range(30)]
    kept = {r["doc_id"] for r in weak_rules.judge(spark.createDataFrame(rows, brute.SCHEMA)).filter("kept").collect()}
    assert kept == set(range(200))


def test_empty_table(spark):
    assert weak_rules.judge(spark.createDataFrame([], brute.SCHEMA)).isEmpty()


def test_repeats_stay_within_texts():
    codes = [np.array(c, np.uint64) for c in ([1, 2, 3, 1, 2, 3], [1, 2, 3], [], [4, 4, 4, 4], [1, 2], [9])]
    assert weak_rules.repeated_words(codes).tolist() == [6, 0, 0, 4, 0, 0]
