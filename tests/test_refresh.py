import json
import os

import pytest
from pyspark.sql import functions as F

from turnledger.operators import incremental, rollups
from turnledger.plans import refresh
from turnledger.plans.refresh import RefreshOptions
from turnledger.schemas import FILE_STATE
from turnledger.sources import rates
from turnledger.sources.store import TABLES, UsageStore
from helpers import record, records
from test_parse import assistant, call, context, meta, tokens, usage


def write(path, items, end="\n", mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as out:
        out.write("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items) + end)


def consistent(store, card):
    """Stored rollups equal rollups of the stored records."""
    rows = store.read("usage_record")
    for name, fresh in (("daily_rollup", rollups.daily_rollup(rows, card)), ("session_rollup", rollups.session_rollup(rows, card))):
        stored = store.read(name)
        fresh = fresh.select(*stored.columns)
        assert stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty(), name
    return True


def test_classification(spark):
    found = spark.createDataFrame(
        [("codex", p, i, s, m) for p, i, s, m in [("new", "new", 1, 9), ("old", "old", 1, 1), ("id", "id2", 5, 5), ("empty", "empty", 5, 5),
         ("same", "same", 5, 5), ("short", "short", 3, 6), ("more", "more", 8, 6), ("touched", "touched", 5, 6)]],
        "source string, file_path string, file_id string, size long, mtime_ms long",
    )
    state = spark.createDataFrame([(p, p, "codex", 5, 5, 5, 0, 0 if p == "empty" else 1, 0, 0, 0) for p in ("id", "empty", "same", "short", "more", "touched")], FILE_STATE)
    day = 86_400_000
    got = {r.file_path: r.action for r in incremental.classify(found.withColumn("mtime_ms", F.col("mtime_ms") * F.when(F.col("file_path").isin("new", "old"), day).otherwise(1)), state, 1, 35 * day).collect()}
    assert got == {"new": "firstRead", "old": "skip", "id": "reingest", "empty": "reingest", "same": "skip", "short": "reingest", "more": "append", "touched": "append"}


@pytest.fixture(scope="module")
def small_card(spark):
    return rates.rate_card(rates.rate_rows(spark, {"m": (0.005, 0, None, 0.03), "m-long-context": (0.01, 0, None, 0.045)}))


def test_refresh_over_a_life_of_files(spark, small_card, tmp_path):
    card, logs = small_card, tmp_path / "logs"
    store = UsageStore(spark, str(tmp_path / "tables"))
    options = RefreshOptions({"codex": str(logs / "codex"), "claude": str(logs / "claude")})
    one, two = logs / "codex" / "2024" / "01" / "05" / "a.jsonl", logs / "claude" / "b.jsonl"
    write(one, [meta("s"), context("m"), call("shell"), tokens(usage(1000, 0, 0, 0), {"input_tokens": 1000})])
    write(two, [assistant("r1", 5), "{\"assistant\" \"usage\" broken"])
    run = lambda now, **kw: {os.path.basename(r.file_path): r.action for r in refresh.refresh(store, options, card, now, **kw).collect()}

    assert run(1) == {"a.jsonl": "firstRead", "b.jsonl": "firstRead"}
    assert store.read("usage_record").count() == 2 and store.read("tool_event").count() == 1
    assert consistent(store, card)
    bad = lambda: {r.warning: r["count"] for r in refresh.warnings(store).filter("model = ''").collect()}
    assert bad() == {"malformed_lines": 1, "oversized_lines": 0}
    assert {r.model for r in store.read("unmapped_model").collect()} == {"claude-sonnet-4-20250514"}

    assert run(2) == {"a.jsonl": "skip", "b.jsonl": "skip"}
    # An append reads the bad line of its file again; it still counts once.
    write(two, [assistant("r0", 1)], mode="a")
    assert run(2)["b.jsonl"] == "append" and bad()["malformed_lines"] == 1
    write(two, [assistant("r1", 5), "{\"assistant\" \"usage\" broken"])
    assert run(2)["b.jsonl"] == "reingest" and bad()["malformed_lines"] == 1
    assert store.read("usage_record").count() == 2

    # An append continues the cumulative totals and takes the session over the threshold.
    write(one, [tokens(usage(301_000, 0, 10, 0), {"input_tokens": 300_000}, ts="2024-01-06T01:00:00Z")], mode="a")
    assert run(3)["a.jsonl"] == "append"
    assert sorted(r.input_tokens for r in store.read("usage_record").filter("source = 'codex'").collect()) == [1000, 300_000]
    assert consistent(store, card)
    first_day = store.read("daily_rollup").filter("day_local = '2024-01-05'").first()
    assert int(first_day.cost_nano) == 1000 * 10_000

    # A line still being written holds the file back; the rows read earlier stay.
    write(one, ['{"type":"event_msg","payload":{"type":"token_count"'], end="", mode="a")
    assert run(4)["a.jsonl"] == "skip"
    assert store.read("usage_record").count() == 3

    # The rest of the line arrives.
    write(one, ['},"info":{"total_token_usage":{"input_tokens":301500,"output_tokens":10}},"timestamp":"2024-01-06T02:00:00Z"}'], mode="a")
    assert run(5)["a.jsonl"] == "append"
    assert store.read("usage_record").count() == 4

    # A rewritten prefix of a longer file is found out; the old day disappears with its rows.
    write(one, [meta("s"), context("m"), *[tokens(usage(100 * i, 0, 0, 0), ts="2024-01-07T00:00:00Z") for i in range(1, 9)]])
    assert run(6)["a.jsonl"] == "reingest"
    assert {r.day_local for r in store.read("usage_record").filter("source = 'codex'").collect()} == {"2024-01-07"}
    assert store.read("usage_record").filter("source = 'codex'").count() == 8 and store.read("tool_event").isEmpty()
    assert consistent(store, card)

    # The store answers by itself.
    found = refresh.report(store, card, rates.merge_audit(rates.default_rates(spark), rates.rate_rows(spark, {"m": (0.005, 0, None, 0.03)})))
    assert found["reconciliation_checked"].first().checked_sessions == 1 and found["pricing"].count() == 1
    assert refresh.latest_rate_limit(store).isEmpty()
    assert {r.source for r in store.read("session").collect()} == {"codex", "claude"}
    assert refresh.tables(store, card).daily.count() == store.read("daily_rollup").count()

    # Only the changed paths are listed.
    write(two, [assistant("r1", 7), assistant("r2", 8)])
    assert run(7, changed=[str(two), "/elsewhere.jsonl"]) == {"b.jsonl": "reingest"}
    catalog = {os.path.basename(r.file_path): r for r in store.read("file_catalog").collect()}
    assert (catalog["b.jsonl"].first_seen_utc, catalog["b.jsonl"].last_changed_utc, catalog["b.jsonl"].state) == (1, 7, "complete")
    assert catalog["a.jsonl"].max_day == "2024-01-07"

    # New rates change costs, not records.
    before = store.read("usage_record").count()
    refresh.reprice(store, rates.rate_card(rates.rate_rows(spark, {"m": (1, 1, 1, 1)})), 8)
    assert int(store.read("daily_rollup").filter("base_model = 'm'").first().cost_nano) == 800 * 1_000_000
    assert store.read("usage_record").count() == before

    assert refresh.rebuild(store, options, card, 9)
    assert consistent(store, card) and store.read("run_metrics").filter("full_rescan").count() == 1
    store.delete_files(store.read("usage_record").filter("source = 'claude'").select("file_id").distinct())
    incremental.refresh_rollups(store, card)
    assert consistent(store, card)
    assert {r.source for r in store.read("usage_record").collect()} == {"codex"}
    one.unlink()
    assert not refresh.rebuild(store, options, card, 10)
    assert store.read("usage_record").count() == 8
    store.clear()
    assert store.read("usage_record").isEmpty() and not store.read("run_metrics").isEmpty()
    store.reset()
    assert all(store.read(name).isEmpty() for name in TABLES)


def test_apply_is_idempotent_and_replaces_by_key(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path / "t"))
    rows = records(spark, record("a", "2024-01-01T00:00:00"), record("b", "2024-01-02T00:00:00", file_id="f2"))
    none = rows.select("file_id").limit(0)
    tools = spark.createDataFrame([], TABLES["tool_event"])
    store.apply(none, rows, tools)
    store.apply(none, rows, tools)
    assert store.read("usage_record").count() == 2
    moved = records(spark, record("a", "2024-01-03T00:00:00", input_tokens=5))
    store.apply(none, moved, tools)
    got = {r.dedup_key: r.day_local for r in store.read("usage_record").collect()}
    assert got == {"a": "2024-01-03", "b": "2024-01-02"}


class Failing(UsageStore):
    """A store whose run ends at its n-th write."""

    def __init__(self, spark, root, writes):
        self.left = 1000
        super().__init__(spark, root)
        self.left = writes

    def _step(self):
        self.left -= 1
        if self.left < 0:
            raise InterruptedError

    def append(self, name, df):
        self._step()
        super().append(name, df)

    def _note(self, path, text):
        self._step()
        super()._note(path, text)

    def _put(self, entry):
        self._step()
        super()._put(entry)
        self._step()


def test_a_run_can_fail_at_any_write_and_be_repeated(spark, small_card, tmp_path):
    """A file moves from one day and session to others; the repeat leaves what a fresh build has."""
    import shutil

    logs, begun = tmp_path / "logs", tmp_path / "begun"
    options = RefreshOptions({"claude": str(logs)})
    moving, staying = logs / "a.jsonl", logs / "b.jsonl"
    other = lambda r, n, **kw: {**assistant(r, n), **kw}
    write(moving, [other("r1", 5, timestamp="2024-01-01T10:00:00Z", sessionId="s1"), other("r2", 5, timestamp="2024-01-02T10:00:00Z", sessionId="s1")])
    write(staying, [other("r3", 7, timestamp="2024-01-01T11:00:00Z", sessionId="s2")])
    refresh.refresh(UsageStore(spark, str(begun)), options, small_card, 1)
    write(moving, [other("r8", 50, timestamp="2024-01-03T10:00:00Z", sessionId="s9"), other("r9", 50, timestamp="2024-01-03T11:00:00Z", sessionId="s9")])
    want = None
    for writes in (5, 14, 1000):  # among the facts, among the rollups, at the end
        root = tmp_path / f"run{writes}"
        shutil.copytree(begun, root)
        failing = Failing(spark, str(root), writes)
        try:
            refresh.refresh(failing, options, small_card, 2)
            failed = False
        except InterruptedError:
            failed = True
        store = UsageStore(spark, str(root))
        if failed:
            refresh.refresh(store, options, small_card, 3)
        assert consistent(store, small_card)
        assert not store._listed(store.path("_journal")) and store.read("pending").isEmpty()
        names = [n for n in TABLES if n not in ("run_metrics", "file_catalog", "unmapped_model")]
        got = {n: sorted(map(str, store.read(n).collect())) for n in names}
        want = want or got
        assert got == want, (writes, [n for n in names if got[n] != want[n]])
        if not failed:
            break
    assert not failed and {r.day_local for r in store.read("usage_record").collect()} == {"2024-01-01", "2024-01-03"}


def test_a_small_change_reads_and_writes_few_partitions(spark, small_card, tmp_path):
    store = UsageStore(spark, str(tmp_path / "t"))
    none = records(spark, record("a", "2024-01-01T00:00:00")).select("file_id").limit(0)
    tools = spark.createDataFrame([], TABLES["tool_event"])
    store.apply(none, records(spark, *[record(f"k{d}", f"2024-01-{d:02}T00:00:00", session_id=f"s{d}") for d in range(1, 21)]), tools)
    incremental.refresh_rollups(store, small_card)
    before = {name: set(store._listed(store.path(name))) for name in ("usage_record", "daily_rollup", "session_rollup")}
    files = lambda name: {f for part in store._listed(store.path(name)) for f in store._listed(part)}
    held = {name: files(name) for name in before}
    store.apply(none, records(spark, record("new", "2024-01-05T00:00:00", session_id="s5")), tools)
    incremental.refresh_rollups(store, small_card)
    for name in before:
        assert set(store._listed(store.path(name))) == before[name]
        touched = {f.rsplit("/", 2)[1] for f in files(name) ^ held[name]}
        assert len(touched) == 1, (name, touched)
    plan = store.read("usage_record", ["2024-01-05"])._jdf.queryExecution().executedPlan().toString()
    assert "day_local" in plan.split("PartitionFilters")[1].split("]")[0] and "2024-01-05" in plan.split("PartitionFilters")[1].split("]")[0]


def test_days_that_no_row_leaves_are_added_to(spark, tmp_path, monkeypatch):
    """Files of such a day stay as they are; a failed addition is finished once, and many small files become few."""
    from turnledger.sources import store as stored
    from helpers import calls

    usage = UsageStore(spark, str(tmp_path / "t"))
    none = records(spark, record("a", "2024-01-01T00:00:00")).select("file_id").limit(0)
    files = lambda name, day: {f for p in usage._listed(usage.path(name)) if p.endswith(day) for f in usage._listed(p)}
    keys = lambda: sorted(r.dedup_key for r in usage.read("usage_record").collect())
    events = lambda: sorted(r.event_key for r in usage.read("tool_event").collect())
    usage.apply(none, records(spark, record("a", "2024-01-01T00:00:00"), record("b", "2024-01-02T00:00:00")), calls(spark, ("a", "x")))
    first = {name: files(name, "2024-01-01") for name in ("usage_record", "tool_event")}

    # The run ends while the second table is put in place.
    failing = Failing(spark, str(tmp_path / "t"), 1000)
    put, failing._put = failing._put, lambda entry: put(entry) if "usage_record" not in entry else (_ for _ in ()).throw(InterruptedError())
    new, new_calls = records(spark, record("c", "2024-01-01T01:00:00")), calls(spark, ("c", "y"))
    with pytest.raises(InterruptedError):
        failing.apply(none, new, new_calls)
    usage.recover()
    usage.recover()
    assert (keys(), events()) == (["a", "b", "c"], ["a#0", "c#0"])
    for name, held in first.items():
        assert held < files(name, "2024-01-01"), name

    # Tool events of a run that failed between the tables do not double, and a key that comes again replaces.
    usage.replace("tool_event", [], calls(spark, ("d", "z")), ["2024-01-01"])
    usage.apply(none, records(spark, record("a", "2024-01-01T00:00:00", input_tokens=3), record("d", "2024-01-01T02:00:00")), calls(spark, ("d", "z")))
    assert (keys(), events()) == (["a", "b", "c", "d"], ["c#0", "d#0"])

    monkeypatch.setattr(stored, "MANY_FILES", 0)
    assert usage.crowded("usage_record", ["2024-01-01", "2024-01-09"]) == ["2024-01-01"]
    usage.apply(none, records(spark, record("e", "2024-01-01T03:00:00")), calls(spark, ("e", "x")))
    assert len(files("usage_record", "2024-01-01")) == 1 and (keys(), events()) == (["a", "b", "c", "d", "e"], ["c#0", "d#0", "e#0"])


def test_a_repeat_after_a_failure_leaves_stored_rows_where_they_are(spark, small_card, tmp_path):
    """A batch that comes again before its rollups are done writes only what differs; all else is as if it had been written."""
    from helpers import calls

    usage = UsageStore(spark, str(tmp_path / "t"))
    day = lambda d: f"2024-01-{d:02}T00:00:00"
    batch = records(spark, *[record(f"k{d}", day(d), session_id=f"s{d % 2}", effort=None) for d in range(1, 5)])
    none, tools = batch.select("file_id").limit(0), calls(spark, ("k1", "x")).withColumn("day_local", F.lit("2024-01-01"))
    files = lambda: {f for p in usage._listed(usage.path("usage_record")) for f in usage._listed(p)}
    events = lambda: sorted((r.event_key, r.tool_name) for r in usage.read("tool_event").collect())
    usage.apply(none, batch, tools)
    assert usage.read("pending").count() == 2 + 4  # sessions and days, not their pairs
    held = files()
    usage.apply(none, batch, tools)
    assert files() == held and events() == [("k1#0", "x")]

    # One record that differs, one with another call, one that is new, one whose key gets no record; the null stays a null.
    other = records(
        spark, record("k2", day(2), session_id="s0", effort=None, input_tokens=400_000, context_used_tokens=300_000, model="m"),
        record("k3", day(3), session_id="s1", effort=None), record("k9", day(9), session_id="s1"),
    )
    keys = other.select("dedup_key").unionByName(spark.createDataFrame([("k4",)], "dedup_key string"))
    usage.apply(none, other, tools.filter("false"), keys)
    assert {f for f in held - files() if "2024-01-01" in f or "2024-01-03" in f} == set()
    usage.apply(none, batch.filter("dedup_key = 'k1'"), tools.withColumn("tool_name", F.lit("y")))
    assert events() == [("k1#0", "y")]
    assert {r.dedup_key for r in usage.read("usage_record").collect()} == {"k1", "k2", "k3", "k9"}
    incremental.refresh_rollups(usage, small_card)
    assert consistent(usage, small_card)

    # A file that is read again gives up its rows, even those that come again as they were.
    usage.append("pending", usage.read("session_day").select("source", "session_id", "model", "day_local"))
    usage.apply(spark.createDataFrame([("f1",)], "file_id string"), batch.filter("dedup_key = 'k3'"), tools.filter("false"))
    assert [r.dedup_key for r in usage.read("usage_record").collect()] == ["k3"] and events() == []
    incremental.refresh_rollups(usage, small_card)
    assert consistent(usage, small_card)


def test_daily_sums_tell_sessions_apart_only_at_long_context_rates(spark, small_card):
    rows = records(spark, *[record(f"{m}{i}", "2024-01-01T00:00:00", session_id=f"s{i}", model=m) for i in range(5) for m in ("m", "other")])
    got = {(r.model, r.session_id): r.turns for r in rollups.daily_sums(rows, small_card).collect()}
    assert got == {("other", None): 5, **{("m", f"s{i}"): 1 for i in range(5)}}


def test_a_first_read_needs_no_file_index(spark, small_card, tmp_path, monkeypatch):
    """Tasks list and read the files of a first run too; Spark's readers, which hold every file on the driver, are not asked."""
    for module, name in ((refresh.inventory, "_listing"), (refresh.line_source, "read_lines")):
        monkeypatch.setattr(module, name, None)
    path = tmp_path / "logs" / "claude" / "b.jsonl"
    write(path, [assistant("r1", 5), assistant("r2", 6)])
    store = UsageStore(spark, str(tmp_path / "tables"))
    refresh.refresh(store, RefreshOptions({"claude": str(tmp_path / "logs")}), small_card, 1)
    assert store.read("usage_record").count() == 2
    assert store.read("run_metrics").first().read_bytes == path.stat().st_size
