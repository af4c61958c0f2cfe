from collections import defaultdict

from tests.llm import brute
from turnledger.llm import licenses


def expected(rows):
    out = defaultdict(lambda: [0.0, 0, None])
    for doc, text in {(d, t) for d, t, *_ in rows if t is not None}:
        words = licenses.normal_words(text)
        shingles = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
        for _, name, size, parts in licenses.template_rows():
            half = 1 << size
            for start in range(0, len(shingles), half):
                share = len(set(shingles[start : start + 2 * half]) & set(parts)) / len(parts)
                if share >= licenses.CONTAINED:
                    one = out[doc, text, name]
                    out[doc, text, name] = [max(one[0], share), one[1] + 1, start if one[2] is None else min(start, one[2])]
    return [(doc, name, *found) for (doc, _, name), found in out.items()]


def test_equals_comparing_every_window_with_every_template(spark):
    rows = brute.corpus()
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        rows.append((5000 + i, "filler words here " * (i * 3) + text + " more words", None, None, 0))
        rows.append((5100 + i, "x " * i + " ".join([*words[: len(words) // 2], *words[len(words) // 2 + 1 :]]), None, None, 0))
        rows.append((5200 + i, text.upper().replace(" ", "\n * "), None, None, 0))
        rows.append((5300 + i, " ".join(words[: max(4, len(words) // 3)]), None, None, 0))
    rows += [rows[-3], (None, licenses.TEMPLATES[0][1], None, None, None), (7, "five words are too few", None, None, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], brute.SCHEMA + ", license string").repartition(3)
    got = [(r["doc_id"], r["license"], r["containment"], r["n_windows"], r["first_word"]) for r in licenses.scan(df).collect()]
    want = expected(rows)
    assert brute.ordered(got) == brute.ordered(want) and len({name for _, name, *_ in got}) == len({n for n, _ in licenses.TEMPLATES})


def test_bands_meet_at_the_least_similarity():
    """The worst case of the docstring: a template of just over half its class, four fifths of it found."""
    worst = 1.0
    for size in range(8):
        for template in range((1 << size) // 2 + 1, (1 << size) + 1):
            found = -(-template * 4 // 5)
            worst = min(worst, found / (2 * (1 << size) + template - found))
    assert (1 - worst) ** licenses.BANDS < 2e-6


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], brute.SCHEMA)).isEmpty()


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame(brute.corpus(), brute.SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
