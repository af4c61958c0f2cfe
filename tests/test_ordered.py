import random

from pyspark.sql import functions as F

from turnledger.operators.ordered import scan


def test_scan_equals_sequential_model(spark):
    rng = random.Random(7)
    rows = []
    for key in "ab":
        for i in range(60):
            rows.append((key, i // rng.choice([4]), i, rng.choice([None, f"v{i}"]), rng.randint(-3, 3)))
    df = spark.createDataFrame(rows, "key string, chunk long, at long, v string, n long")
    got = scan(
        df, ["key"], "chunk", "at",
        sums={"total": F.col("n")}, latest={"upto": F.col("v")},
        previous={"before": F.col("v")}, following={"after": F.col("v")},
    ).collect()
    assert len(got) == len(rows)
    by_row = {(r.key, r["at"]): r for r in got}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        total, last = 0, None
        for i, (_, _, at, v, n) in enumerate(mine):
            row = by_row[(key, at)]
            assert row.before == last
            total += n
            last = v if v is not None else last
            assert (row.total, row.upto) == (total, last)
            assert row.after == next((r[3] for r in mine[i + 1 :] if r[3] is not None), None)


def test_scan_shuffles_by_chunk(spark):
    """The large side is laid out by (key, chunk): no window over a whole key sees its rows."""
    df = spark.range(1000).select(F.lit("hot").alias("key"), (F.col("id") / 10).cast("long").alias("chunk"), "id")
    plan = scan(df, ["key"], "chunk", "id", sums={"s": F.col("id")})._jdf.queryExecution().toString()
    assert "Window" in plan
    out = scan(df, ["key"], "chunk", "id", sums={"s": F.col("id")})
    assert out.agg(F.max("s")).first()[0] == 999 * 1000 // 2
