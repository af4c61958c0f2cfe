import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_language import DE, EN
from turnledger.llm import queries, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = [(i + 20_000, f"{w} " * 30, "en", "s1", 1) for i, w in enumerate(("...", "12 %"))]
    spark.createDataFrame(brute.corpus() + extra, brute.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs))
    return dict(out)


def test_stages_keep_the_columns(spark, folder, stages):
    columns = spark.read.parquet(f"{folder}/documents.parquet").dtypes
    assert all(stages[name].dtypes == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_texts_without_letters_go(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = [r["doc_id"] for r in docs if any(c.isalpha() for c in r["text"] or "")]
    assert brute.ordered((r["doc_id"],) for r in stages["language"].collect()) == brute.ordered((d,) for d in want)
    assert stages["language"].filter("lang IS NULL").isEmpty()


def test_the_language_found_takes_effect(spark):
    """Mislabelled documents get their own language; those in a script that no learned language uses go."""
    draw, rows = random.Random(4), []
    for i in range(120):
        lang, words = (("en", EN), ("de", DE))[i % 2]
        rows.append((i, " ".join(draw.choices(words, k=40)), lang if i % 12 > 1 else {"en": "de", "de": "en"}[lang], "s", 1))
    rows += [(200, "漢字 かな 漢字", "en", "s", 1), (201, "Ωμέγα άλφα", None, "s", 1), (202, "Ωμέγα " + " ".join(EN), None, "s", 1)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {i: ("en", "de")[i % 2] for i in range(120)} | {202: "en"}


def test_one_document_of_each_group_stays(stages):
    rows = stages["language"].collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    by_row = brute.near(list(range(len(rows))), prints)
    kept = stages["near_duplicates"].collect()
    assert len(kept) == len(set(by_row))
    least = {c for c in brute.near([r["doc_id"] for r in rows], prints) if c is not None}
    assert least <= {r["doc_id"] for r in kept}


@pytest.mark.parametrize("part", [4_000, 3])
def test_near_copies_by_shingles_equal_brute_force(spark, part, monkeypatch):
    """Texts of one to many changed words: classes are those of three bits or a Jaccard similarity of 0.8."""
    monkeypatch.setattr(shingles, "PART", part)
    draw, texts = random.Random(8), []
    for _ in range(12):
        base = [f"w{draw.randrange(900)}" for _ in range(draw.choice((4, 30, 120, 250)))]
        for _ in range(8):
            own = list(base)
            for k in draw.sample(range(len(own)), min(len(own), draw.choice((0, 1, 2, 3, 4, 6, 12)))):
                own[k] = f"x{draw.randrange(900)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(brute.words, texts)]
    prints, group = [brute.fingerprint(t) for t in texts], list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            like = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            bits = (prints[i] ^ prints[j]).bit_count()
            far += like and bits > 3
            if like or bits <= 3:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert far > 5
    texts.append("lone " * 30_000)  # a very long text
    group.append(len(group))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], brute.SCHEMA).repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(group)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").isEmpty()


def test_repeated_passages_go_from_the_texts(stages):
    rows = [tuple(r) for r in stages["near_duplicates"].collect()]
    want = {}
    for row, (doc, n_words, removed, _, kept) in zip(rows, brute.passages(rows), strict=True):
        if removed == 0 or removed < n_words:
            want[doc, kept if removed else row[1]] = removed
    assert sum(map(bool, want.values())) > 0
    got = stages["passages"].collect()
    assert {(r["doc_id"], r["text"]) for r in got} == set(want) and len(got) == len(want)


def test_mixture_draws_some_and_changes_none(stages):
    before = {tuple(r) for r in stages["passages"].collect()}
    after = {tuple(r) for r in stages["mixture"].collect()}
    assert after <= before and 0.2 * len(before) < len(after)


def test_all_words_are_packed(stages):
    out = stages["sequences"].toPandas()
    assert out["n_tokens"].sum() == sum(len(brute.words(r["text"])) for r in stages["mixture"].collect())
    assert (out.dropna(subset=["bin_id"]).groupby("bin_id")["n_tokens"].sum() <= out.groupby("bin_id")["capacity"].first()).all()


def test_run_is_the_stages_in_turn(spark, folder, stages):
    out = corpus_pipeline.run(spark, folder).toPandas()
    want = stages["sequences"].toPandas()
    key = ["doc_id", "piece", "start", "n_tokens"]
    assert out[key].sort_values(key).astype("float").to_numpy() == pytest.approx(want[key].sort_values(key).astype("float").to_numpy(), nan_ok=True)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) == {"op6_license_minhash", "op7_raked_mixture", "op11_nsimplex_clustering"} == {n for n in entry.oracle_sql() if n.startswith("op")}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(names) and sorted(str(tuple(r)) for r in got.select(*names).collect()) == want


def test_contract_columns(spark):
    want = {
        "op2": ["doc_id", "fingerprint", "component_id"], "op3": ["page_id", "url", "text", "n_chars"],
        "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op5": ["query_id", "rank", "vec_id", "score"],
        "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op9": ["doc_id", "held_out", "lang_pred", "score"], "op10": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    }
    rows = {"op3": "pages", "op5": None}
    for name, query in queries.QUERIES.items():
        if (op := name.split("_")[0]) in want:
            out = query(spark, "/root/testdata/sf0.001")
            assert out.columns[: len(want[op])] == want[op]
            if table := rows.get(op, "documents"):
                assert out.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
