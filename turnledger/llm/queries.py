"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import (
    factor_quality, html_crf, language_spans, licenses, multi_index, packing, prefix_free_parsing, raking, simhash, simplex_clustering,
    suffix_trees, weak_rules, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op2_simhash_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.with_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free_parsing.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"))


def op6_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.drawn(_table(spark, sf_dir, "documents"), keep=raking.SHARE).withColumn("probability", F.round("probability", 9))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op9_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_spans.train_on_rest(docs)
    found = language_spans.with_language(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", language_spans.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
    )


def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_trees.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_nsimplex_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clustering.clustered(_table(spark, sf_dir, "embeddings"))


def op12_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = factor_quality.with_quality(docs, factor_quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", factor_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_entries(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_simhash_vantage_trees, op3_html_crf, op4_prefix_free_parsing, op5_multi_index_hashing,
        op6_license_minhash, op7_raked_mixture,
        op8_weak_supervision, op9_language_viterbi, op10_suffix_trees, op11_nsimplex_clustering, op12_factorisation_machine,
        op13_cholesky_jacobi_whitening,
    )
}


def _filling_sql(name: str, rows: str, want: str, most: str, total: str) -> list[str]:
    """Tables that end in ``name`` (factor): the sum of least(factor * want, most) over ``rows`` is the total.

    In the order in which rows are full, the first one that the rest of the total does not fill ends the search.
    """
    order = "ORDER BY edge, want, most"
    return [
        f"{name}_edges AS (SELECT {want} AS want, {most} AS most, {most} / {want} AS edge, {total} AS total FROM {rows} WHERE {want} > 0)",
        f"""{name}_steps AS (SELECT edge, (total - coalesce(sum(most) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(want) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM {name}_edges)""",
        f"{name} AS (SELECT coalesce(arg_min(factor, edge) FILTER (factor <= edge), max(edge)) AS factor FROM {name}_steps)",
    ]


def _raked_sql() -> str:
    """The rounds of raking, one common table each: every margin's sum is a window over the cells."""
    names, powers = raking.MARGINS, raking.POWERS
    parts = [
        """measured AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
           CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_matches(text, ' \\| ') THEN 'table'
                WHEN regexp_matches(text, '[0-9]{4}') THEN 'numeric' WHEN length(text) < 400 THEN 'brief' ELSE 'prose' END AS topic,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 12))::BIGINT / pow(2, 48) AS draw
    FROM documents)""",
        "sums AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n_tokens FROM measured GROUP BY ALL)",
        f"budget AS (SELECT {raking.SHARE!r}::DOUBLE * sum(n_tokens) AS budget FROM sums)",
    ]
    for name in names:
        part = f"CASE WHEN sum(n_tokens) > 0 THEN pow(sum(n_tokens), {powers[name]}) ELSE 0 END"
        parts.append(f"""wants_{name} AS MATERIALIZED (SELECT {name}, {part} / sum({part}) OVER () AS want, sum(n_tokens) / any_value(budget) AS most
           FROM sums, budget GROUP BY {name})""")
        parts += _filling_sql(f"level_{name}", f"wants_{name}", "want", "most", "1.0")
        parts.append(f"target_{name} AS MATERIALIZED (SELECT {name}, least(factor * want, most) AS t_{name} FROM wants_{name}, level_{name})")
    joins = " ".join(f"JOIN target_{name} USING ({name})" for name in names)
    parts.append(f"r0 AS MATERIALIZED (SELECT *, n_tokens / budget AS most, n_tokens / budget AS weight FROM sums CROSS JOIN budget {joins})")
    for step in range(raking.ROUNDS * len(names)):
        name = names[step % len(names)]
        held = f"sum(least(weight, most)) OVER (PARTITION BY {name})"
        scaled = f"CASE WHEN {held} > 0 THEN weight * t_{name} / {held} ELSE 0 END AS weight"
        parts.append(f"r{step + 1} AS MATERIALIZED (SELECT * REPLACE ({scaled}) FROM r{step})")
    last = f"r{raking.ROUNDS * len(names)}"
    parts += _filling_sql("level", last, "weight", "n_tokens", "budget")
    parts.append(f"""chances AS (SELECT source, lang, topic, least(factor * CASE WHEN n_tokens > 0 THEN weight / n_tokens ELSE 0 END, 1.0) AS p
    FROM {last}, level)""")
    return "WITH " + ",\n".join(parts) + """
SELECT source, lang, topic, doc_id, draw, n_tokens, round(p, 9) AS probability, draw < p AS kept
FROM measured JOIN chances USING (source, lang, topic)"""


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_license_minhash": licenses.scan_sql(), "op7_raked_mixture": _raked_sql(), "op11_nsimplex_clustering": simplex_clustering.clustered_sql(),
}
