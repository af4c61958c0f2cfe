"""Incremental refresh: which files to read again, and how stored tables change."""

from __future__ import annotations

import secrets
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.functions.rates import LONG_CONTEXT_THRESHOLD
from turnledger.operators.pricing import BILLING_KEY, price_sums
from turnledger.operators.rollups import (
    SESSION_KEY,
    daily_from_priced,
    daily_rollup,
    daily_sums,
    session_rollup,
)
from turnledger.session import staged
from turnledger.sources import ranges
from turnledger.sources.inventory import DAY_MS, DAYS_PER_MONTH

if TYPE_CHECKING:
    from turnledger.sources.store import UsageStore

SKIP, APPEND, REINGEST, FIRST_READ = "skip", "append", "reingest", "firstRead"
_SECRETS = (secrets.randbits(63), secrets.randbits(63))


# --- which files ---------------------------------------------------------------------------------


def classify(inventory: DataFrame, state: DataFrame, backfill_months: int = 0, now_ms: int | None = None) -> DataFrame:
    """Add ``action`` to every listed file. The order of the cases matters."""
    s = state.select(
        "source", "file_path",
        F.col("file_id").alias("_id"), F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"),
        F.col("last_offset").alias("_offset"), (F.col("turns") + F.col("tools")).alias("_held"),
        F.lit(True).alias("_known"),
    )
    c = F.col
    first: Column = F.lit(FIRST_READ)
    if backfill_months > 0 and now_ms is not None:
        cutoff = now_ms - backfill_months * DAYS_PER_MONTH * DAY_MS
        first = F.when(c("mtime_ms") < cutoff, SKIP).otherwise(FIRST_READ)
    action = (
        F.when(c("_known").isNull(), first)
        .when(c("file_id") != c("_id"), REINGEST)
        .when((c("size") > 0) & (c("_held") == 0), REINGEST)
        .when((c("size") == c("_size")) & (c("mtime_ms") == c("_mtime")), SKIP)
        .when(c("size") < c("_offset"), REINGEST)
        .otherwise(APPEND)
    )
    return inventory.join(s, ["source", "file_path"], "left").select(
        *inventory.columns, F.col("_offset").alias("last_offset"), action.alias("action")
    )


def rewritten_files(state: DataFrame) -> DataFrame:
    """Files of ``state`` whose stored prefix no longer reads the same."""
    keys = ["source", "file_path"]
    now = ranges.prefix_anchors(state).select(*keys, F.col("prefix_check").alias("_now"))
    return state.join(now, keys, "left").filter(~F.col("prefix_check").eqNullSafe(F.col("_now"))).select(*keys)


def overlapping_files(appended: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of which an appended record key is stored already."""
    return appended.join(stored.select("dedup_key"), "dedup_key", "left_semi").select("source", "file_id").distinct()


def crossing_sessions(before: DataFrame, after: DataFrame, appended: DataFrame, card: DataFrame) -> DataFrame:
    """(file, session) pairs whose cumulative input passed the threshold in this append.

    Only sessions with a newly read model that has a long-context rate count.
    """
    keys = ["file_path", "session_id"]
    passed = (
        before.select(*keys, F.col("input_total").alias("_before"))
        .join(after.select(*keys, "input_total"), keys)
        .filter((F.col("_before") <= LONG_CONTEXT_THRESHOLD) & (F.col("input_total") > LONG_CONTEXT_THRESHOLD))
    )
    rated = (
        appended.select(F.col("file_id").alias("file_path"), "session_id", "model").distinct()
        .join(card.filter(F.col("long_rate").isNotNull()), "model", "left_semi")
    )
    return passed.join(rated, keys, "left_semi").select(*keys)


def missing_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored (source, path, id) that are not on disk as such any more."""
    keys = ["source", "file_path", "file_id"]
    return stored.select(*keys).join(found, keys, "left_anti")


def rebuild_is_safe(stored: DataFrame, found: DataFrame) -> bool:
    """True if every stored (source, path, id) is still on disk; False for an empty side."""
    return not stored.isEmpty() and not found.isEmpty() and missing_files(stored, found).isEmpty()


def missing_sources(records: DataFrame, found: DataFrame) -> DataFrame:
    """Sources with stored records but no file on disk."""
    return records.select("source").distinct().join(found, "source", "left_anti")


# --- stored tables -------------------------------------------------------------------------------


def upsert_records(old: DataFrame, new: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Replace by record key; ``keys`` may also name keys that get no new record."""
    keys = new if keys is None else keys
    return old.join(keys.select("dedup_key"), "dedup_key", "left_anti").unionByName(new)


def upsert_tools(old: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """Drop the old calls of every record written again, then replace by event key."""
    rewritten = keys.select(F.col("dedup_key").alias("record_dedup_key"))
    return (
        old.join(rewritten, "record_dedup_key", "left_anti")
        .join(new.select("event_key"), "event_key", "left_anti")
        .unionByName(new)
    )


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows without those of the given files."""
    return rows.join(files.select("file_id"), "file_id", "left_anti")


def leaving_rows(old: DataFrame, files: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions and days of the old records that leave: those of the given files, and those
    whose key is written again. Two semi-joins instead of one with OR, so that each is an
    equi-join; the one by file runs on distinct rows, so a large file is few of them.
    """
    names = [*SESSION_KEY, "day_local"]
    by_file = old.select("file_id", *names).distinct().join(files.select("file_id"), "file_id", "left_semi")
    by_key = old.select("dedup_key", *names).join(new.select("dedup_key"), "dedup_key", "left_semi")
    return by_file.select(*names).unionByName(by_key.select(*names))


# Sums over the rows of a key: how many, and two digests of each row in halves of 32 bits, which a long adds up exactly.
_SUMS = ("_n", "_a", "_b", "_c", "_d")


def _told(rows: DataFrame, key: str, given: bool) -> DataFrame:
    """What each whole row adds to ``_SUMS`` of the key it belongs to: stored rows are taken away."""
    names = sorted(rows.columns)  # a join puts its key first
    row = [*[F.col(c) for c in names], *[F.col(c).isNull() for c in names]]
    digests = [F.xxhash64(F.lit(secret), F.lit(key), *row).alias(f"_h{i}") for i, secret in enumerate(_SECRETS)]
    hashed, sign = rows.select(F.col(key).alias("dedup_key"), *digests), F.lit(1 if given else -1).cast("bigint")
    halves = [half * sign for h in ("_h0", "_h1") for half in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return hashed.select("dedup_key", F.lit(given).alias("_given"), *[c.alias(n) for c, n in zip((sign, *halves), _SUMS, strict=True)])


def changed_keys(old: DataFrame, old_tools: DataFrame, new: DataFrame, tools: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` and of the new rows whose stored record and calls are not just the new ones.

    The rows of a key are compared by their number and by sums of digests (128 bits, keyed with a secret of
    this run), so no row meets another, and a key with many rows is added up like any other.
    """
    parts = [_told(new, "dedup_key", True), _told(tools, "record_dedup_key", True),
             _told(old, "dedup_key", False), _told(old_tools, "record_dedup_key", False)]
    told = keys.select("dedup_key", F.lit(True).alias("_given"), *[F.lit(0).cast("bigint").alias(c) for c in _SUMS])
    for part in parts:
        told = told.unionByName(part)
    sums = told.groupBy("dedup_key").agg(F.max("_given").alias("_given"), *[F.sum(c).alias(c) for c in _SUMS])
    differs = F.lit(False)
    for c in _SUMS:
        differs = differs | (F.col(c) != 0)
    return sums.filter(F.col("_given") & differs).select("dedup_key")


def leaving_tools(old: DataFrame, files: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """Days of the old tool events that ``delete_files`` and ``upsert_tools`` drop."""
    by_file = old.select("file_id", "day_local").distinct().join(files.select("file_id"), "file_id", "left_semi")
    rewritten = keys.select(F.col("dedup_key").alias("record_dedup_key"))
    by_record = old.select("record_dedup_key", "day_local").join(rewritten, "record_dedup_key", "left_semi")
    by_event = old.select("event_key", "day_local").join(new.select("event_key"), "event_key", "left_semi")
    return by_file.select("day_local").unionByName(by_record.select("day_local")).unionByName(by_event.select("day_local")).distinct()


def replace_files(old: DataFrame, files: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the files leave, the new ones enter."""
    return delete_files(old, files).unionByName(new)


def touched_days(*rows: DataFrame) -> DataFrame:
    """Days of any of the given records, repeats included."""
    out = rows[0].select("day_local")
    for part in rows[1:]:
        out = out.unionByName(part.select("day_local"))
    return out


def pending_rows(*rows: DataFrame) -> DataFrame:
    """Sessions and days met in any of the given records, each in rows of its own: their pairs are nearly as many as the records."""
    sessions = rows[0].select(*SESSION_KEY)
    for part in rows[1:]:
        sessions = sessions.unionByName(part.select(*SESSION_KEY))
    none = F.lit(None).cast("string")
    return (
        sessions.distinct().select(*SESSION_KEY, none.alias("model"), none.alias("day_local"))
        .unionByName(touched_days(*rows).distinct().select(*[none.alias(c) for c in BILLING_KEY], "day_local"))
    )


def session_days(records: DataFrame) -> DataFrame:
    """Days of each billing key with its largest context: what a refresh must know of all records."""
    return records.groupBy(*BILLING_KEY, "day_local").agg(F.max("context_used_tokens").alias("max_context"))


def long_keys_of_days(days: DataFrame) -> DataFrame:
    """Billing keys whose context ever went above the threshold."""
    return (
        days.filter(F.col("max_context") > LONG_CONTEXT_THRESHOLD)
        .groupBy(*BILLING_KEY).agg(F.max("max_context").alias("key_context"))
    )


def refresh_rollups(store: UsageStore, card: DataFrame) -> None:
    """Bring the stored rollups up to date for what is pending.

    A session that newly counts as long context changes the cost of its turns on every day it has,
    so the days are those pending and all others of the pending sessions, which the small table of
    session days tells. Only these days of the records are read, and only touched partitions of the
    rollups are written.
    """
    pending = store.read("pending")
    if pending.isEmpty():
        return
    keys = staged(pending.select(*SESSION_KEY).filter("session_id IS NOT NULL").distinct(), "touched")
    held = store.read("session_day", store.parts_of("session_day", keys)).join(keys, SESSION_KEY, "left_semi")
    days = store.parts_of("usage_record", touched_days(pending, held).filter("day_local IS NOT NULL"))
    records = store.read("usage_record", days)
    mine = records.join(keys, SESSION_KEY, "left_semi")
    store.replace_rows("session_day", keys, SESSION_KEY, session_days(mine))
    store.replace_rows("session_rollup", keys, SESSION_KEY, session_rollup(mine, card))
    priced = price_sums(daily_sums(records, card), card, long_keys=long_keys_of_days(store.read("session_day")))
    store.replace("daily_rollup", days, daily_from_priced(priced))
    store.done_pending()


def reprice(records: DataFrame, card: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both rollups under new rates, from stored records; no log is read."""
    return daily_rollup(records, card), session_rollup(records, card)


# --- file catalog --------------------------------------------------------------------------------


def catalog_discovered(catalog: DataFrame, inventory: DataFrame, now_ms: int) -> DataFrame:
    """Catalog after a listing: new files enter, changed files are marked, unseen ones stay."""
    found = inventory.select(
        "file_path", F.col("file_id").alias("_id"), F.col("source").alias("_source"),
        F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"), F.lit(True).alias("_found"),
    )
    c, now = F.col, F.lit(now_ms).cast("bigint")
    seen = c("_found").isNotNull()
    is_new = c("first_seen_utc").isNull()
    changed = seen & ~is_new & (
        (c("file_id") != c("_id")) | (c("size") != c("_size")) | (c("mtime_ms") != c("_mtime"))
    )
    return catalog.join(found, "file_path", "full_outer").select(
        "file_path",
        F.coalesce("_id", "file_id").alias("file_id"),
        F.coalesce("_source", "source").alias("source"),
        F.coalesce("_size", "size").alias("size"),
        F.coalesce("_mtime", "mtime_ms").alias("mtime_ms"),
        F.coalesce("first_seen_utc", now).alias("first_seen_utc"),
        F.when(seen, now).otherwise(c("last_seen_utc")).alias("last_seen_utc"),
        F.when(is_new | changed, now).otherwise(c("last_changed_utc")).alias("last_changed_utc"),
        "last_checked_utc", "last_ingested_utc", "min_day", "max_day",
        F.when(is_new, "discovered").when(changed, "changed").otherwise(c("state")).alias("state"),
    )


def catalog_ingested(catalog: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Catalog after a run. ``results``: file_path, action, has_state, min_day, max_day."""
    r = results.select(
        "file_path", F.col("action").alias("_action"), F.col("has_state").alias("_has"),
        F.col("min_day").alias("_min"), F.col("max_day").alias("_max"),
    )
    c, now = F.col, F.lit(now_ms).cast("bigint")
    checked = c("_action").isNotNull()
    read = checked & (c("_action") != SKIP)
    return catalog.join(r, "file_path", "left").select(
        "file_path", "file_id", "source", "size", "mtime_ms", "first_seen_utc", "last_seen_utc", "last_changed_utc",
        F.when(checked, now).otherwise(c("last_checked_utc")).alias("last_checked_utc"),
        F.when(read, now).otherwise(c("last_ingested_utc")).alias("last_ingested_utc"),
        F.when(read, c("_min")).otherwise(c("min_day")).alias("min_day"),
        F.when(read, c("_max")).otherwise(c("max_day")).alias("max_day"),
        F.when(checked & c("_has"), "complete").when(checked, "ignored").otherwise(c("state")).alias("state"),
    )
