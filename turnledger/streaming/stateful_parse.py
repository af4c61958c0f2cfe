"""Parsing a stream of log lines, with the state of each file kept between micro-batches.

Every micro-batch runs the batch operators on its new rows behind the rows carried from the batches
before (``operators/carry``), so a batch boundary changes nothing and one busy file is still spread
over many tasks. The carried rows lie in the stream's keyed state (``carry_state``). The output of
a batch lies in folders named by the batch id; a repeated batch meets the same state and overwrites
the same folders.

The stream brings ``source, file_path, line_offset, value``, as ``growing`` and ``announced`` do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnledger.operators import claude, codex, resume
from turnledger.operators.logrows import FILE_KEYS
from turnledger.session import discard, staged
from turnledger.sources.lines import DEFAULT_MAX_LINE_BYTES
from turnledger.streaming import carry_state

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TYPED, CARRIED = "typed", "carried"

Handler = Callable[[DataFrame, DataFrame, DataFrame, int], None]


class Outputs:
    """What the batches of a stream gave, in one folder per table and batch."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def keep(self, batch: int, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def latest(self, name: str) -> DataFrame:
        """Records or tool events so far, without those a later batch replaced."""
        key = "dedup_key" if name == "records" else "record_dedup_key"
        keys = self.spark.read.parquet(f"{self.folder}/turn_keys")
        last = keys.groupBy(F.col("dedup_key").alias(key)).agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{self.folder}/{name}").join(last, [key, "batch"], "left_semi").drop("batch")

    def quality(self) -> DataFrame:
        """Malformed and oversized lines per file, over all batches so far."""
        counts = [F.sum(c).alias(c) for c in ("malformed_count", "oversized_count")]
        return self.spark.read.parquet(f"{self.folder}/quality").groupBy(*FILE_KEYS).agg(*counts)

    def to_reread(self) -> DataFrame:
        """Files whose state had been dropped when they went on; a refresh has to read them again."""
        return self.spark.read.parquet(f"{self.folder}/to_reread").select(*FILE_KEYS).distinct()


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with the columns that a range reader gives beside."""
    more = {"n_bytes": F.octet_length("value").cast("bigint") + 1, "ended": F.lit(True), "read_bytes": F.lit(None).cast("bigint")}
    return lines.withColumns({name: value for name, value in more.items() if name not in lines.columns})


def _rows(lines: DataFrame, max_line_bytes: int, idle_ms: int | None) -> DataFrame:
    """Typed rows and carried rows in one frame, told apart by which struct is there. Two reads of a batch's bytes."""
    placed = _placed(lines).filter(F.col("line_offset").isNotNull())
    both = resume.typed_both(placed, max_line_bytes)
    carry = carry_state.carried(carry_state.steps(both, placed), idle_ms)
    return both.select(F.struct(*both.columns).alias(TYPED)).unionByName(carry.select(F.struct(*carry.columns).alias(CARRIED)), allowMissingColumns=True)


def start(
    lines: DataFrame, folder: str, checkpoint: str, on_batch: Handler | None = None, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    idle_ms: int | None = None, **trigger: object,
) -> StreamingQuery:
    """Parse a stream of lines; ``on_batch`` receives records, tool events and keys of each batch.

    With ``idle_ms`` the state of a file goes after so many milliseconds without a line. If it goes on
    later, its lines are not parsed and the file is listed in ``to_reread``.
    """
    spark = lines.sparkSession
    outputs = Outputs(spark, folder)
    rows = _rows(lines, max_line_bytes, idle_ms)

    def handle(batch_rows: DataFrame, batch: int) -> None:
        held = staged(batch_rows, "batch")  # the stateful plan runs once
        both, carry = (held.filter(F.col(kind).isNotNull()).select(f"{kind}.*") for kind in (TYPED, CARRIED))
        is_lost = F.col("part") == carry_state.LOST
        lost = outputs.keep(batch, "to_reread", carry.filter(is_lost).select(*FILE_KEYS))
        known = both.join(lost, FILE_KEYS, "left_anti")
        out = resume.finish(resume.typed_of(known, codex), resume.typed_of(known, claude), carry.filter(~is_lost))
        parsed = out.parsed
        outputs.keep(batch, "quality", parsed.quality)
        kept = [outputs.keep(batch, n, df) for n, df in (("records", parsed.records), ("tool_events", parsed.tool_events), ("turn_keys", out.turn_keys))]
        if on_batch:
            on_batch(*kept, batch)
        discard(held)

    # An offset names every file, and each progress report that the driver keeps holds three of them.
    # Keyed state with a clock asks for one empty batch after the other, so that a run over what is there never ends.
    settings = {STATE_STORE: ROCKS_DB, PROGRESS: "2", NO_DATA: "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return (
            rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
