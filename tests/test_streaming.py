"""Replays through Structured Streaming against the batch operators."""
import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from logweir.operators import detect, rules
from logweir.operators.dashboard import events_per_minute
from logweir.operators.parse import parse_logs, pipeline_counts
from logweir.operators.windows import sliding_count
from logweir.plans.sample_events import events_as_ecs, read
from logweir.plans.sample_logs import events_as_syslog
from logweir.plans.samples import TUNED_RULES, feed_lines
from logweir.schema import ALERT, ALERT_COLUMNS, EVENT, RAW_LOG
from logweir.sources import feeds
from logweir.sources.raw_logs import read_raw_logs
from logweir.sources.store import read_events, write_alerts
from logweir.streaming import folds as folds_of
from logweir.streaming import jobs, stateful

DAY = 86_400


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return events_as_ecs(read(spark, sf_dir, "events"))


@pytest.fixture(scope="module")
def replay(spark, events, tmp_path_factory):
    """The events in three files out of order within a day, and a last file that moves the watermark on."""
    folder = str(tmp_path_factory.mktemp("replay"))
    rows = events.withColumn("part", F.floor(F.unix_seconds("ts") / (10 * DAY)))
    for number, part in enumerate(sorted(r.part for r in rows.select("part").distinct().collect())):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").json(f"{folder}/{number}")
    late = events.limit(1).withColumn("ts", F.lit(dt.datetime(2024, 6, 1)))
    late.write.json(f"{folder}/9")
    return folder


def run(spark, replay, tmp_path, build, name):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{replay}/*")
    query = (build(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def alerts_of(df):
    """Alert rows without those of the event that only moves the clock."""
    rows = df.filter("created_at < '2024-05-01'").select(*ALERT_COLUMNS).collect()
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in rows), key=repr)


def test_rules_replay(spark, events, replay, tmp_path):
    """All seven rules, with dedup and throttle, give the alerts of the table."""
    want = alerts_of(rules.evaluate_rules(events, TUNED_RULES))
    got = alerts_of(run(spark, replay, tmp_path, lambda e: stateful.evaluate_rules_stream(e, "2 days", TUNED_RULES), "s_rules"))
    assert got == want and len({r[1] for r in want}) >= 4


def test_correlate_replay(spark, events, replay, tmp_path):
    """Whole alert rows of all detectors, in both sinks, equal the batch ones."""
    batch = {"brute_force": lambda e: detect.brute_force(e, DAY, 3), "port_scan": lambda e: detect.port_scan(e, DAY, 2),
             "lateral_movement": lambda e: detect.lateral_movement(e, DAY, 2)}
    stream = {"brute_force": lambda e: stateful.brute_force_stream(e, DAY, 3), "port_scan": lambda e: stateful.port_scan_stream(e, DAY, 2),
              "lateral_movement": lambda e: stateful.lateral_movement_stream(e, DAY, 2)}
    want = alerts_of(detect.correlate(events, {**detect.DEFAULT_DETECTORS, **batch}))
    found = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{replay}/*")
    alerts = stateful.correlate_stream(found, "2 days", {**stateful.STREAM_DETECTORS, **stream})
    seen = {"live": [], "stored": []}
    query = jobs.start_alerts(alerts, {"live": lambda a: seen["live"].extend(a.collect()), "stored": lambda a: write_alerts(a, str(tmp_path / "alerts"))},
                              str(tmp_path / "ckpt"), trigger={"availableNow": True})
    query.awaitTermination(300)
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert alerts_of(stored) == want and {r[1] for r in want} == set(detect.DEFAULT_DETECTORS)
    assert alerts_of(spark.createDataFrame(seen["live"], ALERT)) == want


def test_sliding_and_rate_replay(spark, events, replay, tmp_path):
    got = run(spark, replay, tmp_path, lambda e: stateful.sliding_count_stream(
        e.select(F.col("source.ip").alias("key"), "ts", F.col("event.id").alias("id")), "2 days", DAY), "s_sliding")
    want = sliding_count(events, F.col("source.ip"), F.col("ts"), F.col("event.id"), DAY)
    columns = ["key", "ts_ms", "id", "count"]
    assert {tuple(r) for r in got.filter("ts_ms < 1714521600000").select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}
    minutes = run(spark, replay, tmp_path / "c", lambda e: stateful.events_per_minute_stream(e, "2 days"), "s_rate")
    assert {tuple(r) for r in minutes.collect()} == {tuple(r) for r in events_per_minute(events).collect()}


def rows_through(fold, key, batches):
    """Outputs of a fold over batches of (mark, rows), and the entries it is left with; the state is a plain dictionary."""
    memory, out, ends = {name: {} for name, _, _ in fold.maps}, [], None
    for mark, rows in batches:
        fold.begin(memory, key)
        for row in rows:
            out += list(fold.take(memory, Row(**row)))
        ends = fold.prune(memory, mark)
    return out, sum(map(len, memory.values())), ends


def test_folds_step_by_step():
    """Windows, markers and what is forgotten, against the definitions."""
    rng, t, times, batches = random.Random(3), 0, [], []
    for i in range(60):
        part = []
        for _ in range(4):
            t += rng.choice([0, 1, 900, 3000])
            times.append(t)
            part.append({"ts_ms": t, "tie": str(i)})
        batches.append((t, part))
    out, left, ends = rows_through(folds_of.SlidingFold(5000), ("k",), batches)
    assert [c for _, _, c in out] == [sum(1 for u in times[:i + 1] if u > t - 5000) for i, t in enumerate(times)]
    assert left <= 5001 and ends > times[-1]
    rows = [(0, "a"), (5, "a"), (6, "b"), (10, "a"), (12, "b"), (20, "a")]
    out, left, ends = rows_through(folds_of.SuppressFold(), ("k",), [
        (t, [{"ts_ms": t, "tie": str(t), "dedup_key": key, "dedup_ms": 10, "throttle_ms": 12}]) for t, key in rows])
    assert [d for _, d in out] == ["emitted", "deduplicated", "throttled", "throttled", "deduplicated", "emitted"]
    assert rows_through(folds_of.SuppressFold(), ("k",), [(0, [{"ts_ms": 0, "tie": "", "dedup_key": "a", "dedup_ms": 10, "throttle_ms": 12}]),
                                                          (12, [])])[1:] == (0, None)


def test_ingest_stream(spark, sf_dir, tmp_path):
    """Two batches, the second with late lines and a blank one; then the second again, as after a failure."""
    source, out = str(tmp_path / "raw"), str(tmp_path / "events")
    lines = events_as_syslog(read(spark, sf_dir, "events")).persist()
    parsed = parse_logs(lines).select("id", F.unix_millis("parsed.ts").alias("ms")).filter("ms IS NOT NULL").persist()
    cut = parsed.agg(F.expr("percentile_approx(ms, 0.7)")).first()[0]
    old = [r.id for r in parsed.filter(F.col("ms") <= cut).limit(40).collect()]
    lines.join(parsed.filter(F.col("ms") > cut).select("id").unionByName(parsed.filter((F.col("ms") <= cut) & ~F.col("id").isin(old)).select("id")), "id").coalesce(1).write.json(f"{source}/0")
    blank = lines.limit(1).withColumns({"raw": F.lit(" \x00 "), "id": F.lit("blank")})
    lines.filter(F.col("id").isin(old)).unionByName(blank).coalesce(1).write.json(f"{source}/1")
    entries = feeds.feed_entries(feed_lines(read(spark, sf_dir, "supplier")))
    loads = []

    def load():
        loads.append(1)
        return {"ips": feeds.feed_ips(entries), "blocks": feeds.feed_cidrs(entries), "oui": feeds.builtin_oui(spark)}
    raw = read_raw_logs(spark, source, streaming=True)
    assert raw.schema == RAW_LOG
    raw = spark.readStream.schema(RAW_LOG).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    counts, late = str(tmp_path / "counts"), str(tmp_path / "late")

    def ingest():
        query = jobs.start_ingest(raw, dimensions, out, str(tmp_path / "rejects"), str(tmp_path / "ckpt"), trigger={"availableNow": True},
                                  counts_path=counts, late_path=late, delay_seconds=60)
        assert query.awaitTermination(300)
    dimensions = jobs.Dimensions(load)
    for attempt in range(2):
        ingest()
        stored, rejects = read_events(spark, out), spark.read.parquet(str(tmp_path / "rejects"))
        behind = spark.read.parquet(f"{late}/events")
        mark = parsed.agg(F.max("ms")).first()[0] - 60_000
        assert {r.id for r in behind.select("event.id").collect()} == set(old) and parsed.filter(F.col("id").isin(old) & (F.col("ms") > mark)).count() == 0
        assert stored.count() + behind.count() == parsed.count() and {"event_date", "batch"} <= set(stored.columns) and len(loads) == 1
        done = parse_logs(lines.join(stored.select("event.id").unionByName(behind.select("event.id")).unionByName(rejects.select("id")), "id"))
        assert {tuple(r) for r in spark.read.parquet(counts).groupBy("dataset", "status").agg(F.sum("n").alias("n")).select("dataset", "status", "n").collect()} == \
            {tuple(r) for r in pipeline_counts(done).collect()}
        # The last batch runs again when its commit is missing.
        last = max(int(p.name) for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            (tmp_path / "ckpt" / "commits" / name).unlink(missing_ok=True)


def test_dimensions_refresh_and_survive_failure():
    now, answers = [0.0], [{"v": 1}, RuntimeError("down"), {"v": 2}]

    def load():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer
    tables = jobs.Dimensions(load, max_age=10, clock=lambda: now[0])
    assert tables.current() == {"v": 1}
    now[0] = 9
    assert tables.current() == {"v": 1}
    now[0] = 10
    assert tables.current() == {"v": 1}
    assert tables.current() == {"v": 2}
