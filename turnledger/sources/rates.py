"""Rate tables: the bundled list, JSON files with comments, and their merge."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger.functions.rates import DEFAULT_RATES, LONG_CONTEXT_SUFFIX
from turnledger.session import broadcast_if_small

RATE_COLUMNS = ("input_rate", "cached_rate", "write_rate", "output_rate")
# Field names of a rate in a rate file, in the order of RATE_COLUMNS.
RATE_FIELDS = ("inputPer1K", "cachedInputPer1K", "cacheCreationPer1K", "outputPer1K")
FALLBACK_KEY = "$fallback"

RATE_TYPE = "decimal(18,6)"  # nano-USD per token
MAX_BROADCAST_MODELS = 10_000


def nano(usd_per_1k: float | None) -> Decimal:
    """USD per 1,000 tokens as nano-USD per token, exactly."""
    return Decimal(str(usd_per_1k or 0)) * 1_000_000


def rate_rows(spark: SparkSession, rates: dict[str, tuple[float | None, ...]]) -> DataFrame:
    """A rates frame from a dict; an inline table, so its size is known to the optimizer."""
    values = ", ".join(
        "("
        + ", ".join(
            ["'" + model.replace("\\", "\\\\").replace("'", "\\'") + "'"]
            + [f"CAST({nano(r):f} AS {RATE_TYPE})" for r in rate]
        )
        + ")"
        for model, rate in rates.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(model, {', '.join(RATE_COLUMNS)})")


def default_rates(spark: SparkSession) -> DataFrame:
    return rate_rows(spark, DEFAULT_RATES)


def read_rate_file(spark: SparkSession, path: str) -> DataFrame:
    """Rates in a JSON file that may hold comments.

    Keys starting with ``$`` are skipped, except the fallback; values that are not objects are
    dropped. Each value is parsed by itself, so one bad value does not lose the others.
    """
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(
        F.explode(F.from_json("value", "map<string,string>", {"allowComments": "true"})).alias("model", "body")
    ).filter(~F.startswith("model", F.lit("$")) | (F.col("model") == FALLBACK_KEY))
    doc = F.try_parse_json(F.col("body"))
    return entries.filter(F.schema_of_variant(doc).startswith("OBJECT")).select(
        "model",
        *[
            (F.coalesce(F.try_variant_get(doc, f"$.{field}", "decimal(18,12)"), F.lit(0)) * 1_000_000)
            .cast(RATE_TYPE)
            .alias(column)
            for field, column in zip(RATE_FIELDS, RATE_COLUMNS, strict=True)
        ],
    )


def merge_rates(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Bundled rates win; only models they do not know are added."""
    custom = overrides.filter(~F.startswith("model", F.lit("$")))
    return defaults.unionByName(custom.join(defaults, "model", "left_anti"))


def merge_audit(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """What became of each override: ignored (known model), ignored (fallback) or accepted."""
    known = defaults.select("model", F.lit(True).alias("_known"))
    return (
        overrides.join(known, "model", "left")
        .filter((F.col("model") == FALLBACK_KEY) | ~F.startswith("model", F.lit("$")))
        .select(
            F.when(F.col("model") == FALLBACK_KEY, "ignored_fallback")
            .when(F.col("_known"), "ignored_known_model")
            .otherwise("custom_model")
            .alias("outcome"),
            "model",
        )
        .orderBy("outcome", "model")
    )


def long_context_id(model: Column) -> Column:
    return F.when(F.endswith(model, F.lit(LONG_CONTEXT_SUFFIX)), model).otherwise(
        F.concat(model, F.lit(LONG_CONTEXT_SUFFIX))
    )


def rate_card(rates: DataFrame) -> DataFrame:
    """One row per model with its own rate and its long-context rate side by side (null = none).

    A model whose only entry is ``x-long-context`` still gives ``x`` a row.
    """
    rate = F.struct(*RATE_COLUMNS)
    suffix = F.lit(LONG_CONTEXT_SUFFIX)
    stem = F.col("model").substr(F.lit(1), F.length("model") - len(LONG_CONTEXT_SUFFIX))
    long_rates = rates.filter(F.endswith("model", suffix))
    none = F.lit(None).cast(f"struct<{','.join(f'{c}:{RATE_TYPE}' for c in RATE_COLUMNS)}>")
    sides = (
        rates.select("model", rate.alias("rate"), none.alias("long_rate"))
        .unionByName(long_rates.select("model", none.alias("rate"), rate.alias("long_rate")))
        .unionByName(
            long_rates.filter(~F.endswith(stem, suffix)).select(
                stem.alias("model"), none.alias("rate"), rate.alias("long_rate")
            )
        )
    )
    return sides.groupBy("model").agg(
        F.first("rate", ignorenulls=True).alias("rate"),
        F.first("long_rate", ignorenulls=True).alias("long_rate"),
    )


def default_card(spark: SparkSession) -> DataFrame:
    """Card of the bundled rates, as an inline table of known size."""
    def literal(rate: tuple[float | None, ...] | None) -> str:
        kind = f"STRUCT<{', '.join(f'{c}: {RATE_TYPE}' for c in RATE_COLUMNS)}>"
        if rate is None:
            return f"CAST(NULL AS {kind})"
        parts = ", ".join(
            f"'{c}', CAST({nano(r):f} AS {RATE_TYPE})" for c, r in zip(RATE_COLUMNS, rate, strict=True)
        )
        return f"named_struct({parts})"

    rows = []
    for model, rate in DEFAULT_RATES.items():
        long_model = model if model.endswith(LONG_CONTEXT_SUFFIX) else model + LONG_CONTEXT_SUFFIX
        rows.append(f"('{model}', {literal(rate)}, {literal(DEFAULT_RATES.get(long_model))})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(model, rate, long_rate)")


def card_with(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Card of the bundled rates plus custom ones; broadcast only after its size is checked."""
    if overrides is None:
        return default_card(spark)
    return broadcast_if_small(
        rate_card(merge_rates(default_rates(spark), overrides)), MAX_BROADCAST_MODELS
    )
