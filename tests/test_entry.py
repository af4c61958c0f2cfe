import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = ("a01_daily_rollup", "q03_variant_breakdown", "q06_tool_usage", "q08_hourly_series", "w07_period_buckets", "r05_record_cost", "i01_classified_files")


def test_every_query_has_sql():
    without = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not n.startswith("op")}
    assert not without


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_chunk_width_does_not_change_the_rendered_lines(spark):
    from turnledger.plans import samples

    wide = samples.unsized_log_lines(spark, FOLDER, chunk_bits=20).select("file_path", "pos", "value")
    narrow = samples.unsized_log_lines(spark, FOLDER, chunk_bits=5).select("file_path", "pos", "value")
    assert wide.exceptAll(narrow).isEmpty() and narrow.exceptAll(wide).isEmpty()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_chunk_width_does_not_change_the_parse(spark):
    """All sessions in many small chunks give the records of one chunk per file."""
    from turnledger.operators import normalize
    from turnledger.plans import samples
    from turnledger.session import staged

    out = []
    for bits in (20, 5):
        logs = staged(samples.unsized_log_lines(spark, FOLDER, chunk_bits=bits), "lines")
        parsed = normalize.parse_lines(logs)
        out.append((parsed.records, parsed.tool_events, parsed.quality))
    for a, b in zip(*out, strict=True):
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
