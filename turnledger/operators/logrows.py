"""From raw lines to the few typed rows a parser needs.

The text of a line never leaves the scan stage: each line is cut down to its length, a few typed
fields and two flags before anything is shuffled. Only rows a parser uses, plus one closing row per
chunk that carries the chunk's byte count, go further.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger.operators.ordered import scan
from turnledger.sources.lines import (
    DEFAULT_MAX_LINE_BYTES,
    is_oversized,
    line_bytes,
    line_text,
)

FILE_KEYS = ["source", "file_path"]


def nonblank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def number(value: Column) -> Column:
    """A JSON number, read as text, as a whole number; ``5.0`` and ``5`` are the same."""
    return value.try_cast("double").try_cast("bigint")


def event_time(raw: Column) -> Column:
    """Epoch milliseconds of a timestamp; null where it is missing or cannot be read.

    ``raw`` is the JSON value with its type: a number is milliseconds, a text is a date, so the
    text "2024" is a year and a quoted number of milliseconds is nothing.
    """
    kind, text = F.schema_of_variant(raw), F.try_variant_get(raw, "$", "string")
    as_date = F.unix_millis(text.try_cast("timestamp"))
    return F.when(kind == "STRING", as_date).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number(text))


def json_doc(line: Column, schema: str) -> Column:
    """A parsed line. Scalars are read as text, so a field of another type never spoils the rest."""
    return F.from_json(line, schema, {"mode": "PERMISSIVE"})


def is_malformed(line: Column) -> Column:
    """True for lines that are not exactly one JSON value: text after it counts as well.

    Between brackets a line must give an array of one element. Null for a null line.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(line.isNotNull(), listed.isNull() | ~alone)


def mentions(line: Column, *words: str) -> list[Column]:
    return [F.contains(line, F.lit(f'"{word}"')) for word in words]


def parsed_lines(cut: DataFrame, schema: str) -> DataFrame:
    """Add ``malformed`` and ``doc`` to rows with a ``candidate`` line; a malformed line has no doc."""
    judged = cut.withColumn("malformed", F.coalesce(is_malformed(F.col("candidate")), F.lit(False)))
    return judged.withColumn("doc", json_doc(F.when(~F.col("malformed"), F.col("candidate")), schema))


def cut_rows(
    lines: DataFrame,
    keyword: Callable[[Column], Column],
    schema: str,
    extract: Callable[[DataFrame], DataFrame],
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
) -> DataFrame:
    """Typed rows of the useful lines, with their place inside the chunk.

    ``keyword`` says which lines are worth parsing; only those can be malformed. ``extract`` turns
    the parsed ``doc`` (of ``schema``) into typed fields, one of them ``kind`` (null = of no use).
    """
    oversized = is_oversized(max_line_bytes)
    cut = lines.select(
        *FILE_KEYS, "chunk", "pos", "file_size",
        line_bytes().alias("n_bytes"),
        oversized.alias("oversized"),
        F.when(~oversized & keyword(F.col("value")), line_text()).alias("candidate"),
    )
    parsed = parsed_lines(cut, schema)
    typed = extract(parsed).drop("doc", "candidate")

    by_chunk = Window.partitionBy(*FILE_KEYS, "chunk").orderBy("pos")
    local = typed.select(
        "*",
        F.sum("n_bytes").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("chunk_end"),
        F.lead("pos").over(by_chunk).isNull().alias("closes_chunk"),
    )
    return local.filter(
        F.col("kind").isNotNull() | F.col("malformed") | F.col("oversized") | F.col("closes_chunk")
    )


def placed(cut: DataFrame, **running: Mapping[str, Column]) -> DataFrame:
    """Add ``line_offset`` to cut rows, and any other running columns in the same scan.

    The closing row of a chunk holds the chunk's byte count, so the running sum of those alone
    gives the offset at which each chunk starts.
    """
    own_close = F.when(F.col("closes_chunk"), F.col("chunk_end"))
    sums = {"_upto": own_close, **running.pop("sums", {})}
    return (
        scan(cut, FILE_KEYS, "chunk", "pos", sums=sums, **running)
        .withColumn(
            "line_offset",
            F.col("_upto") - F.coalesce(own_close, F.lit(0)) + F.col("chunk_end") - F.col("n_bytes"),
        )
        .drop("_upto")
    )


def quality(rows: DataFrame) -> DataFrame:
    """Per file: malformed and oversized line counts."""
    return rows.groupBy(*FILE_KEYS).agg(
        F.count_if("malformed").alias("malformed_count"),
        F.count_if("oversized").alias("oversized_count"),
    )


def incomplete_files(rows: DataFrame) -> DataFrame:
    """Files still being written: no final newline and a last line that does not parse.

    Their batch is not applied; the rows stored earlier stay.
    """
    closing = rows.filter("closes_chunk").groupBy(*FILE_KEYS).agg(
        F.sum("chunk_end").alias("_bytes"),
        F.max("file_size").alias("_size"),
        F.max_by("malformed", "chunk").alias("_bad"),
    )
    return closing.filter((F.col("_bytes") - F.col("_size") == 1) & F.col("_bad")).select(*FILE_KEYS)


def without_incomplete(rows: DataFrame) -> DataFrame:
    """Rows of complete files. The join runs by chunk, so a large file is not one join key."""
    chunks = rows.filter("closes_chunk").select(*FILE_KEYS, "chunk")
    dropped = chunks.join(incomplete_files(rows), FILE_KEYS)
    return rows.join(dropped, [*FILE_KEYS, "chunk"], "left_anti")


def file_scope(file_path: Column) -> Column:
    """Short stable token for a file inside record keys."""
    return F.substring(F.sha2(file_path, 256), 1, 16)
