"""Log lines with exact byte offsets.

A lines frame has one row per physical line:

``source``       which assistant wrote the file
``file_path``    identity of the file
``chunk``        start of the file block the line was read from; orders the chunks of a file
``pos``          order of the line inside its chunk
``value``        text of the line, without the newline
``file_size``    size of the file in bytes

A block is at most ``spark.sql.files.maxPartitionBytes`` long, so no chunk grows with its file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger.operators.ordered import scan

# Limits of the maximum line length.
DEFAULT_MAX_LINE_BYTES = 1_048_576
MIN_MAX_LINE_BYTES = 4_096


def _decoded(path: Column) -> Column:
    # File metadata is percent-encoded; a literal plus sign is not a space there.
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: Sequence[str], source: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of the given files or folders. ``lineSep`` is fixed so that CR bytes stay in the value."""
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(list(paths))
        .select(
            F.lit(source).alias("source"),
            _decoded(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
            F.col("_metadata.file_size").alias("file_size"),
        )
    )


def line_bytes() -> Column:
    """Bytes the line takes in its file, newline included."""
    return F.octet_length("value").cast("bigint") + 1


def line_text() -> Column:
    """The line without one trailing CR."""
    return F.regexp_replace("value", "\r$", "")


def effective_limit(max_line_bytes: int) -> int:
    return max(MIN_MAX_LINE_BYTES, int(max_line_bytes))


def is_oversized(max_line_bytes: int) -> Column:
    return F.octet_length("value") > effective_limit(max_line_bytes)


def with_offsets(lines: DataFrame) -> DataFrame:
    """Add ``line_offset``, the byte at which each line starts, and ``n_bytes``.

    Columns that are not used afterwards, the text among them, are pruned before the shuffle.
    """
    sized = lines.withColumn("n_bytes", line_bytes())
    return (
        scan(sized, ["source", "file_path"], "chunk", "pos", sums={"_end": F.col("n_bytes")})
        .withColumn("line_offset", F.col("_end") - F.col("n_bytes"))
        .drop("_end")
    )


def emitted_lines(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Lines that reach a parser: offset kept, oversized and empty lines left out."""
    judged = lines.withColumn("line", line_text()).withColumn(
        "_emitted", ~is_oversized(max_line_bytes) & (F.length("line") > 0)
    )
    return (
        with_offsets(judged)
        .filter("_emitted")
        .select("source", "file_path", "chunk", "pos", "line_offset", "n_bytes", "line")
    )


def oversized_counts(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Per file: lines read and lines over the limit."""
    return lines.groupBy("source", "file_path").agg(
        F.count("*").alias("line_count"),
        F.count_if(is_oversized(max_line_bytes)).alias("oversized_count"),
    )
