"""Stored tables as Parquet folders.

Facts and daily rollups are partitioned by local day, the other large tables by a hash bucket of
their key. A change reads the touched partitions only: one that old rows leave is replaced, one that
only gains rows gets new files. Every such change is written down first: its content is complete in the store's own folder and a journal entry names it
before any partition is touched; then partition folders or files are moved into place, so ``recover``
can finish it after a failure and nothing is written twice. Sessions and
days whose rollups are not up to date yet stand in the ``pending`` table from before the facts
change until the rollups are done. So a run can fail at any step and be repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from turnledger import schemas
from turnledger.operators import incremental
from turnledger.session import staged
from turnledger.sources.folders import Folders

TABLES: dict[str, T.StructType] = {
    "usage_record": schemas.USAGE_RECORD,
    "tool_event": schemas.TOOL_EVENT,
    "daily_rollup": schemas.DAILY_ROLLUP,
    "session_rollup": schemas.SESSION_ROLLUP,
    "session_day": schemas.SESSION_DAY,
    "session": schemas.SESSION,
    "rate_limit": schemas.RATE_LIMIT,
    "file_state": schemas.FILE_STATE,
    "running_total": schemas.RUNNING_TOTAL,
    "carry": schemas.CARRY,
    "file_day": schemas.FILE_DAY,
    "file_catalog": schemas.FILE_CATALOG,
    "unmapped_model": schemas.UNMAPPED_MODEL,
    "run_metrics": schemas.RUN_METRICS,
    "pending": schemas.PENDING,
}
BY_DAY = ("usage_record", "tool_event", "daily_rollup")
# Columns whose hash gives the bucket of a row.
BY_BUCKET = {
    "session_rollup": ("source", "session_id"), "session_day": ("source", "session_id"), "session": ("file_path",),
    "rate_limit": ("file_path",), "file_state": ("file_path",), "running_total": ("file_path",), "carry": ("file_path",), "file_day": ("file_id",), "file_catalog": ("file_path",),
}
BUCKETS = 32
# A partition of more files than this is written anew if they are small on average.
MANY_FILES, SMALL_FILE = 16, 16 << 20
# Kept when ingested data is cleared for a full rescan; a reset drops these too.
KEPT_ON_CLEAR = ("run_metrics",)

def part_column(name: str) -> str | None:
    return "day_local" if name in BY_DAY else "bucket" if name in BY_BUCKET else None


class UsageStore:
    """Named tables under one root folder. A store keeps the number of buckets it was begun with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.folders = Folders(spark)
        noted = self.path("_buckets")
        self.buckets = int(self._noted(noted)) if self._exists(noted) else buckets or BUCKETS
        if not self._exists(noted):
            self._note(noted, str(self.buckets))

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*BY_BUCKET[name]), F.lit(self.buckets)).cast("int")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, parts: Sequence[str | int] | None = None) -> DataFrame:
        """A table, or some of its days or buckets: a literal filter, so that only they are listed and read."""
        schema = TABLES[name]
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], schema).limit(0)  # so that joins with it are dropped from a plan
        stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]) if name in BY_BUCKET else schema
        table = self.spark.read.schema(stored).parquet(self.path(name))
        if parts is not None:
            table = table.filter(F.col(part_column(name)).isin(list(parts)))
        return table.select(*schema.fieldNames())

    def parts_of(self, name: str, rows: DataFrame) -> list[str | int]:
        """Days or buckets that ``rows`` fall into: as many values as the table has partitions at most."""
        value = F.col("day_local") if name in BY_DAY else self.bucket(name)
        return sorted(row[0] for row in rows.select(value.alias("p")).distinct().collect())

    def overwrite(self, name: str, df: DataFrame) -> None:
        """Replace a whole table; its new content may be derived from the old."""
        self._journalled(name, df, [], whole=True)

    def append(self, name: str, df: DataFrame) -> None:
        df.select(*TABLES[name].fieldNames()).write.mode("append").parquet(self.path(name))

    def replace(self, name: str, parts: Sequence[str | int], df: DataFrame, added: Sequence[str | int] = ()) -> None:
        """Replace the partitions ``parts`` with ``df``; one without rows is dropped.

        The rows of ``df`` lie in ``parts``, or in ``added``: those join what these partitions hold.
        """
        if parts or added:
            self._journalled(name, df, parts, whole=False, added=added)

    def crowded(self, name: str, parts: Sequence[str | int]) -> list[str | int]:
        """Those of ``parts`` that hold many small files."""
        column, found = part_column(name), []
        for part in parts:
            files, size = self.folders.held(f"{self.path(name)}/{column}={part}")
            if files > MANY_FILES and size < files * SMALL_FILE:
                found.append(part)
        return found

    def replace_rows(self, name: str, keys: DataFrame, on: Sequence[str], df: DataFrame) -> None:
        """In a bucketed table, replace the rows with ``keys`` (of columns ``on``) by ``df``."""
        parts = self.parts_of(name, keys.select(*BY_BUCKET[name]))
        kept = self.read(name, parts).join(keys.select(*on).distinct(), list(on), "left_anti")
        self.replace(name, parts, kept.unionByName(df.select(*kept.columns)))

    def clear(self) -> None:
        """Drop ingested data, keep run metrics."""
        self._drop(self.path(name) for name in (*TABLES, "_journal", "_content") if name not in KEPT_ON_CLEAR)

    def reset(self) -> None:
        """Drop everything."""
        self._drop(self.path(name) for name in (*TABLES, "_journal", "_content"))

    def delete_files(self, files: DataFrame) -> None:
        """Delete the records and tool events of the given files; their rollups become pending."""
        none = self.spark.createDataFrame([], TABLES["usage_record"])
        self.apply(files, none, self.spark.createDataFrame([], TABLES["tool_event"]))

    def apply(self, files: DataFrame, records: DataFrame, tools: DataFrame, keys: DataFrame | None = None) -> None:
        """Put the rows of re-read ``files`` in the place of their old ones.

        Old rows with one of ``keys`` (by default the keys of the new records) go as well. If ``keys``
        has a column ``file_id``, a key belongs to that file, as keys of parsed records do, and only
        the days of the files at hand are looked at; else an old row may lie on any day.
        Touched sessions and days are added to ``pending`` first. Days that no old row leaves are not
        read again: the new rows are added to them. If a run before has left something pending, records that
        are stored just so, calls included, are left where they are.
        """
        keys = records.select("dedup_key", "file_id") if keys is None else keys
        days = self.days_of(files, keys)
        old = self.read("usage_record", days)
        if self._exists(self.path("pending")):
            # A run ended before its rollups: these rows may be those that it has stored.
            staying = [incremental.delete_files(rows, files) for rows in (old, self.read("tool_event", days))]
            changed = staged(incremental.changed_keys(*staying, records, tools, keys), "changed")
            if changed.isEmpty() and files.isEmpty():
                return
            records = staged(records.join(changed, "dedup_key", "left_semi"), "records")
            tools = tools.join(changed.withColumnRenamed("dedup_key", "record_dedup_key"), "record_dedup_key", "left_semi")
            keys = keys.join(changed, "dedup_key", "left_semi")
        leaving = staged(incremental.leaving_rows(old, files, keys), "leaving")
        days = self.parts_of("usage_record", incremental.touched_days(leaving, records))
        if not days:
            return
        self.append("pending", incremental.pending_rows(leaving, records))
        self._note_days(records)
        held_tools = self.read("tool_event", days)
        # Of the tool events themselves: a run that failed between the two tables has stored them without records.
        changed, added = self._changed("tool_event", days, incremental.leaving_tools(held_tools, files, keys, tools))
        kept_tools = incremental.delete_files(self.read("tool_event", changed), files)
        self.replace("tool_event", changed, incremental.upsert_tools(kept_tools, keys, tools), added)
        changed, added = self._changed("usage_record", days, leaving)
        kept = incremental.delete_files(self.read("usage_record", changed), files)
        self.replace("usage_record", changed, incremental.upsert_records(kept, records, keys), added)

    def _changed(self, name: str, days: Sequence[str], leaving: DataFrame) -> tuple[list[str], list[str]]:
        """Those of ``days`` to be written anew, and those that only gain rows."""
        left = {*self.parts_of(name, leaving), *self.crowded(name, days)}
        return [d for d in days if d in left], [d for d in days if d not in left]

    def days_of(self, files: DataFrame, keys: DataFrame) -> list[str] | None:
        """Days that may hold rows of ``files`` or old copies of ``keys``; None for any day."""
        if not self._exists(self.path("usage_record")):
            return []
        if not self._exists(self.path("file_day")) or "file_id" not in keys.columns:
            return None
        involved = files.select("file_id").unionByName(keys.select("file_id"))
        held = self.read("file_day", self.parts_of("file_day", involved)).join(involved.distinct(), "file_id", "left_semi")
        return self.parts_of("usage_record", held)

    def _note_days(self, records: DataFrame) -> None:
        """Add the days of ``records`` to the index, before they are stored: it may name a day too many, never one too few.

        A store begun without the index goes on without it.
        """
        if self._exists(self.path("usage_record")) and not self._exists(self.path("file_day")):
            return
        given = records.select("file_id", "day_local")
        held = self.read("file_day", self.parts_of("file_day", given))
        new = staged(given.distinct().join(held, ["file_id", "day_local"], "left_anti"), "new-file-days")
        parts = self.parts_of("file_day", new)
        full = self.crowded("file_day", parts)
        self.replace("file_day", full, self.read("file_day", full).unionByName(new), [p for p in parts if p not in full])

    def done_pending(self) -> None:
        """The rollups hold what ``pending`` names."""
        self._drop([self.path("pending")])

    def recover(self) -> None:
        """Finish the replacements that a failed run left; each gives the same however often it is done."""
        for entry in self._listed(self.path("_journal")):
            if not entry.endswith(".tmp"):
                self._put(entry)
            self._drop([entry])
        # Content without an entry was never begun to be put in place.
        self._drop([self.path("_content")])

    def _journalled(self, name: str, df: DataFrame, parts: Sequence[str | int], whole: bool, added: Sequence[str | int] = ()) -> None:
        mark = uuid.uuid4().hex
        content, entry = f"{self.path('_content')}/{name}-{mark}", f"{self.path('_journal')}/{name}-{mark}"
        rows = df.select(*TABLES[name].fieldNames())
        if name in BY_BUCKET:
            rows = rows.withColumn("bucket", self.bucket(name))
        column = part_column(name)
        if column:
            # A few files per partition: small ones are put together, one that is too large is split.
            rows.hint("rebalance", column).write.partitionBy(column).parquet(content)
        else:
            rows.write.parquet(content)
        filled = self._parts(content)
        gone = self._parts(self.path(name)) if whole else [f"{column}={part}" for part in parts]
        joined = [f"{column}={part}" for part in added]
        self._note(entry, json.dumps({
            "name": name, "content": content, "filled": filled, "gone": sorted(set(gone) - set(filled)), "split": bool(column), "added": joined,
        }))
        self._put(entry)
        self._drop([entry, content])

    def _parts(self, path: str) -> list[str]:
        """Names of a table's partition folders."""
        return [name for name in (folder.rpartition("/")[2] for folder in self._listed(path)) if "=" in name]

    def _put(self, entry: str) -> None:
        """Move the content of a journal entry into its table; what a failed run has moved is no longer there to move."""
        note = json.loads(self._noted(entry))
        target, content = self.path(note["name"]), note["content"]
        moves = [(f"{content}/{part}", f"{target}/{part}") for part in note["filled"]] if note["split"] else [(content, target)]
        added = {f"{target}/{part}" for part in note.get("added", [])}
        for begun, ended in moves:
            if ended in added:  # names of files are those of one write, so none is met twice
                for file in self._listed(begun):
                    self.folders.move(file, f"{ended}/{file.rpartition('/')[2]}")
            elif self._exists(begun):
                self.folders.move(begun, ended)
        self._drop(f"{target}/{part}" for part in note["gone"])

    def _note(self, path: str, text: str) -> None:
        """Write a small file; it appears whole, by a rename."""
        fs, target = self.folders.at(path)
        _, begun = self.folders.at(f"{path}.tmp")
        out = fs.create(begun, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(begun, target)

    def _noted(self, path: str) -> str:
        fs, target = self.folders.at(path)
        reader = fs.open(target)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
        reader.close()
        return text

    def _exists(self, path: str) -> bool:
        return self.folders.exists(path)

    def _listed(self, path: str) -> list[str]:
        return self.folders.listed(path)

    def _drop(self, paths: Iterable[str]) -> None:
        self.folders.drop(paths)
