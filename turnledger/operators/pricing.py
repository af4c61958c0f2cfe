"""Cost of turns, in exact nano-USD.

Pricing is linear in tokens, so it runs on sums wherever a report allows it: records are first
added up per (source, session, model, ...), which also takes the heat out of a session that holds
a large share of all rows. Only the per-record report joins at record grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger.functions.columns import TOKEN_COLUMNS
from turnledger.functions.rates import FALLBACK_RATE, LONG_CONTEXT_THRESHOLD
from turnledger.sources.rates import RATE_COLUMNS, RATE_TYPE, long_context_id, nano

BILLING_KEY = ["source", "session_id", "model"]
# A key with more than one in so many of all records is dealt in parts of about that size.
SHARES = 1024
# Keys that the sketch of frequent keys tracks: its counts are then off by a tenth of such a part at most.
TRACKED = 16_384


def _fallback() -> Column:
    return F.struct(
        *[F.lit(nano(r)).cast(RATE_TYPE).alias(c) for c, r in zip(RATE_COLUMNS, FALLBACK_RATE, strict=True)]
    )


def long_context_keys(records: DataFrame) -> DataFrame:
    """Billing keys whose context ever went above the threshold, over all records."""
    return (
        records.filter(F.col("context_used_tokens") > LONG_CONTEXT_THRESHOLD)
        .groupBy(*BILLING_KEY)
        .agg(F.max("context_used_tokens").alias("key_context"))
    )


def status_columns(card: DataFrame, requested: Column) -> dict[str, Column]:
    """Long-context status and rate of a row joined to the card."""
    applied = requested & F.col("long_rate").isNotNull()
    rate = F.when(applied, F.col("long_rate")).otherwise(F.col("rate"))
    return {
        "long_context_requested": requested,
        "long_context_applied": applied,
        "long_context_missing_rate": requested & F.col("long_rate").isNull(),
        "effective_model": F.when(applied, long_context_id(F.col("model"))).otherwise(F.col("model")),
        "cost_unknown": rate.isNull(),
        "billed_rate": F.coalesce(rate, _fallback()),
    }


def cost_nano(rate: str = "billed_rate") -> Column:
    """Tokens times rate over the five buckets; reasoning is billed as output."""
    billed_at = dict(
        zip(TOKEN_COLUMNS, ("input_rate", "output_rate", "cached_rate", "write_rate", "output_rate"), strict=True)
    )
    parts = [
        F.col(bucket).cast("decimal(17,0)") * F.col(f"{rate}.{column}")
        for bucket, column in billed_at.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole + part
    return whole.cast("decimal(38,6)")


def price_sums(
    sums: DataFrame,
    card: DataFrame,
    *,
    keys: Sequence[str] | None = BILLING_KEY,
    long_keys: DataFrame | None = None,
) -> DataFrame:
    """Price pre-aggregated sums.

    Whether a key is billed at its long-context rate comes from ``long_keys``, or else from the
    largest ``max_context`` of the key inside ``sums``; without ``keys`` each row is a whole key.
    """
    if keys is None:
        known = sums.withColumn("_context", F.col("max_context"))
    elif long_keys is None:
        over_key = Window.partitionBy(*keys)
        known = sums.withColumn("_context", F.max("max_context").over(over_key))
    else:
        known = sums.join(
            long_keys.select(*keys, F.col("key_context").alias("_context")), list(keys), "left"
        )
    requested = F.coalesce(F.col("_context") > LONG_CONTEXT_THRESHOLD, F.lit(False))
    rated = known.join(card, "model", "left").withColumns(status_columns(card, requested))
    return rated.withColumn("cost_nano", cost_nano()).drop("_context", "rate", "long_rate", "billed_rate")


def hot_keys(records: DataFrame, keys: Sequence[str] = BILLING_KEY) -> DataFrame:
    """(_hash, _parts) of the keys that hold more than one in ``SHARES`` of all records: fewer than ``SHARES`` rows.

    A sketch of frequent keys per task is merged into one, so no key is shuffled to be counted.
    """
    hashed = records.select(F.xxhash64(*keys).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {SHARES}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    parts = F.ceil(F.col("top.count") * F.lit(SHARES) / F.col("n")).cast("int")
    return found.select("n", F.explode("top").alias("top")).select(F.col("top.item").alias("_hash"), parts.alias("_parts")).filter("_parts > 1")


def spread(records: DataFrame, hot: DataFrame, keys: Sequence[str] = BILLING_KEY) -> DataFrame:
    """Add ``_salt``: the part of its key that a record is dealt to, 0 for keys that are not hot."""
    hashed = records.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(hot), "_hash", "left")
    salt = F.pmod(F.xxhash64("dedup_key"), F.coalesce("_parts", F.lit(1))).cast("int")
    return hashed.withColumn("_salt", salt).drop("_hash", "_parts")


def price_records(records: DataFrame, card: DataFrame) -> DataFrame:
    """Every record with its status and cost.

    The join deals the records of a hot session in parts (see ``hot_keys``), and copies its flag
    once for each part; the flags of all other sessions are there once.
    """
    hot = hot_keys(records)
    salted = spread(records, hot)
    flagged = long_context_keys(records).withColumn("_hash", F.xxhash64(*BILLING_KEY)).join(F.broadcast(hot), "_hash", "left")
    flagged = flagged.select(
        *BILLING_KEY, "key_context", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt")
    )
    known = salted.join(flagged, [*BILLING_KEY, "_salt"], "left")
    requested = F.coalesce(F.col("key_context") > LONG_CONTEXT_THRESHOLD, F.lit(False))
    rated = known.join(card, "model", "left").withColumns(status_columns(card, requested))
    return rated.withColumn("cost_nano", cost_nano()).select(
        *records.columns,
        "long_context_requested", "long_context_applied", "long_context_missing_rate",
        "effective_model", "cost_unknown", "cost_nano",
    )


def unmapped_models(records: DataFrame, card: DataFrame) -> DataFrame:
    """Models met in the records that have no rate of their own."""
    return (
        records.select("model")
        .distinct()
        .join(card.filter(F.col("rate").isNotNull()), "model", "left_anti")
    )


def refresh_unmapped(stored: DataFrame, unmapped: DataFrame, now_ms: Column) -> DataFrame:
    """Unmapped-model table after a run: first-seen times stay, models now mapped leave."""
    old = stored.select("model", F.col("first_seen_utc").alias("_seen"))
    return unmapped.join(old, "model", "left").select(
        "model", F.coalesce("_seen", now_ms).alias("first_seen_utc")
    )


def register_fallback(rates: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Stored rate registry with a fallback entry for models it does not hold yet."""
    new = unmapped.join(rates, "model", "left_anti").select("model", _fallback().alias("_f"))
    return rates.unionByName(new.select("model", "_f.*"))
