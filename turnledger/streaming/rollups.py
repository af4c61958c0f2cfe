"""Streams of records: dedup, tumbling rollups, and the stored daily rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnledger.functions.columns import TOKEN_COLUMNS, instant
from turnledger.operators import incremental
from turnledger.schemas import USAGE_RECORD
from turnledger.session import staged
from turnledger.sources.folders import Folders
from turnledger.sources.store import UsageStore

MERGED = 16  # parts put into one

_MEASURES = (*TOKEN_COLUMNS, "total_tokens")


def deduplicated(records: DataFrame, recent: str | None = None) -> DataFrame:
    """First record per key; run it after requests are collapsed.

    Without ``recent`` all keys stay in the state store, which should be on disk (RocksDB). With
    it ("6 hours") keys stay for so long after they arrived, whatever time the record itself tells, so
    no record is late and the state is bounded; ``unstored`` finds the copies that come later still.
    """
    if recent is None:
        return records.dropDuplicates(["dedup_key"])
    timed = records.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", recent)
    return timed.dropDuplicatesWithinWatermark(["dedup_key"]).drop("arrived")


def unstored(records: DataFrame, store: UsageStore) -> DataFrame:
    """Records whose key is not in the store yet: only the days of their own files are looked at."""
    keys = records.select("dedup_key", "file_id")
    held = store.read("usage_record", store.days_of(keys.select("file_id").limit(0), keys))
    return records.join(held.select("dedup_key"), "dedup_key", "left_anti").select(*records.columns)


def into_store_once(records: DataFrame, store: UsageStore, checkpoint: str, recent: str = "6 hours") -> StreamingQuery:
    """Store each record once, the first that comes; recent copies meet in state, older ones in the store.

    A batch that comes again after a failure finds its records stored and adds none.
    """

    def handle(batch_rows: DataFrame, batch: int) -> None:
        store.recover()
        fresh = staged(unstored(batch_rows.select(*USAGE_RECORD.fieldNames()), store), "fresh")
        store.apply(fresh.select("file_id").limit(0), fresh, store.read("tool_event", []))

    return (
        deduplicated(records, recent).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def window_sums(records: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sums per window and source of one batch. The sums are partial before the shuffle, so one
    busy source does not put its rows into one task."""
    return (
        records.groupBy(F.window(instant(F.col("ts_utc")), width), "source")
        .agg(*[F.sum(c).alias(c) for c in _MEASURES], F.count("*").alias("turns"))
        .select(F.unix_millis("window.start").alias("window_start_utc"), "source", *_MEASURES, "turns")
    )


def window_totals(parts: DataFrame) -> DataFrame:
    """Windows over all batches so far: sums add up, so a late record counts whenever it comes."""
    return parts.groupBy("window_start_utc", "source").agg(*[F.sum(c).alias(c) for c in (*_MEASURES, "turns")])


def _part(folder: str, level: int, number: int) -> str:
    return f"{folder}/level={level}/batch={number}"


def _whole(folders: Folders, path: str) -> bool:
    return folders.exists(f"{path}/_SUCCESS")


def _merged_above(folders: Folders, folder: str, level: int, number: int) -> bool:
    """Whether a part of a higher level holds this one."""
    levels = range(level + 1, 1 + len(folders.listed(folder)))
    return any(_whole(folders, _part(folder, up, number // MERGED ** (up - level))) for up in levels)


def _merge(spark: SparkSession, folder: str, batch: int) -> None:
    """Put each full run of MERGED parts into one of the next level; a merge that was done is not done again."""
    folders, level, number = Folders(spark), 0, batch
    while number % MERGED == MERGED - 1:
        parts = [_part(folder, level, number - k) for k in range(MERGED)]
        level, number = level + 1, number // MERGED
        merged = _part(folder, level, number)
        if not _whole(folders, merged) and not _merged_above(folders, folder, level, number):
            sums = window_totals(spark.read.parquet(*[p for p in parts if _whole(folders, p)]))
            sums.coalesce(1).write.mode("overwrite").parquet(merged)
        folders.drop(parts)


def stored_parts(spark: SparkSession, folder: str) -> list[str]:
    """The parts that together hold every batch once: of a merged run the merged part."""
    folders = Folders(spark)
    found = []
    for level_folder in folders.listed(folder):
        level = int(level_folder.rpartition("=")[2])
        found += [(level, int(p.rpartition("=")[2]), p) for p in folders.listed(level_folder) if _whole(folders, p)]
    known = {(level, number) for level, number, _ in found}
    levels = range(1, 1 + max((level for level, *_ in found), default=0))
    above = lambda level, number: any((up, number // MERGED ** (up - level)) in known for up in levels if up > level)
    return sorted(path for level, number, path in found if not above(level, number))


def stored_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over all batches that ``into_windows`` wrote."""
    return window_totals(spark.read.parquet(*stored_parts(spark, folder)))


def into_windows(records: DataFrame, folder: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Write the window sums of every batch to a part of its own; read them by ``stored_windows``.

    No state and no watermark: a window never closes, and a repeated batch overwrites its part. Parts are
    merged in runs of MERGED, so as many stay as the logarithm of the batches.
    """

    def handle(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        if not _merged_above(Folders(spark), folder, 0, batch):
            window_sums(batch_rows, width).write.mode("overwrite").parquet(_part(folder, 0, batch))
        _merge(spark, folder, batch)

    return (
        records.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def into_folder(updates: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every batch to a folder of its own; a repeated batch overwrites it."""

    def handle(batch_rows: DataFrame, batch: int) -> None:
        batch_rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return (
        updates.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def into_store(store: UsageStore, card: DataFrame) -> Callable[[DataFrame, DataFrame, DataFrame, int], None]:
    """Batch handler: replace turns by key in the store, then compute the touched rollups afresh.

    Every step is a replacement that a later call finishes if this one fails, so a batch that is
    delivered again changes nothing.
    """

    def handle(records: DataFrame, tools: DataFrame, keys: DataFrame, batch: int) -> None:
        store.recover()
        store.apply(records.select("file_id").limit(0), records, tools, keys)
        incremental.refresh_rollups(store, card)

    return handle
