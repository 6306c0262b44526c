"""Folds against plain sequential simulations on random events."""
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from logweir.operators import folds
from logweir.operators.windows import sliding_count


def simulate_count(rows, n, window_ms):
    state, out = {}, []
    for key, t in sorted(rows, key=lambda r: (r[0], r[1])):
        q = [x for x in state.get(key, []) if x > t - window_ms] + [t]
        if len(q) >= n:
            out.append((key, t))
            q = []
        state[key] = q
    return sorted(out)


def simulate_distinct(rows, n, window_ms=None, bucket_ms=None):
    state, out = {}, []
    for key, t, item in sorted(rows):
        k = (key, t // bucket_ms) if bucket_ms else key
        seen = {i: x for i, x in state.get(k, {}).items() if bucket_ms or x > t - window_ms}
        seen.pop(item, None)
        seen[item] = t
        if len(seen) >= n:
            out.append((key, t, item, tuple(i for _, i in sorted((x, i) for i, x in seen.items()))))
            seen = {}
        state[k] = seen
    return sorted(out)


def simulate_suppress(rows, dedup_ms, throttle_ms):
    dedup, throttle, out = {}, {}, {}
    for group, key, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if dedup.get((group, key), t) > t:
            continue
        dedup[group, key] = t + dedup_ms
        if throttle.get(group, t) > t:
            out[i] = "throttled"
            continue
        throttle[group] = t + throttle_ms
        out[i] = "emitted"
    return out


def random_times(rng, size, dense):
    t, out = 1_700_000_000_000, []
    for _ in range(size):
        t += rng.choice([0, 0, 1, 200, 900, 1500]) if dense else rng.choice([0, 300, 2000, 7000, 30000])
        out.append(t)
    return out


@pytest.fixture(params=[1, 600_000])
def chunk_ms(request, monkeypatch):
    monkeypatch.setattr(folds, "MIN_CHUNK_MS", request.param)


@pytest.mark.parametrize("seed,n,window,dense", [(1, 3, 4, True), (2, 10, 10, True), (3, 4, 20, False), (4, 2, 5, True)])
def test_count_fold(spark, chunk_ms, seed, n, window, dense):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), t) for t in random_times(rng, 1500, dense)]
    got = folds.reset_fold(spark.createDataFrame(rows, "key string, ts_ms long"), n, window, distinct=False)
    fired = sorted((r.key, r.ts_ms) for r in got.collect() for _ in range(r.times))
    assert fired == simulate_count(rows, n, window * 1000)
    assert fired


@pytest.mark.parametrize("seed,n,window,items,dense", [
    (1, 3, 4, 5, True), (2, 10, 20, 12, True), (3, 4, 30, 40, False), (4, 2, 5, 2, True), (5, 5, 6, 200, True)])
def test_distinct_fold(spark, chunk_ms, seed, n, window, items, dense):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), t, f"d{rng.randrange(items):03d}") for t in random_times(rng, 1500, dense)]
    got = folds.reset_fold(spark.createDataFrame(rows, "key string, ts_ms long, item string"), n, window, distinct=True)
    fired = sorted((r.key, r.ts_ms, r.item, tuple(r["items"])) for r in got.collect())
    want = [(k, t, i, s[:20]) for k, t, i, s in simulate_distinct(rows, n, window_ms=window * 1000)]
    assert fired == want
    assert fired


@pytest.mark.parametrize("seed,n,bucket,items", [(1, 3, 5, 6), (2, 15, 60, 30), (3, 2, 1, 3)])
def test_bucket_fold(spark, seed, n, bucket, items):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), t, str(rng.randrange(items))) for t in random_times(rng, 1500, True)]
    got = folds.bucket_fold(spark.createDataFrame(rows, "key string, ts_ms long, item string"), n, bucket)
    fired = sorted((r.key, r.ts_ms, r.item) for r in got.collect())
    assert fired == [r[:3] for r in simulate_distinct(rows, n, bucket_ms=bucket * 1000)]
    assert fired


@pytest.mark.parametrize("seed,dedup,throttle,keys", [(1, 10, 4, 1), (2, 4, 10, 1), (3, 6, 9, 3), (4, 20, 20, 2), (5, 0, 7, 1)])
def test_suppress(spark, seed, dedup, throttle, keys):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), f"k{rng.randrange(keys)}", t, f"{i:05d}")
            for i, t in enumerate(random_times(rng, 800, False))]
    df = spark.createDataFrame(rows, "group_key string, dedup_key string, ts_ms long, id string").withColumns({
        "rule_no": F.lit(0), "dedup_ms": F.lit(dedup * 1000).cast("long"),
        "throttle_ms": F.lit(throttle * 1000).cast("long")})
    got = {r.id: r.disposition for r in folds.suppress(df).collect()}
    assert got == simulate_suppress(rows, dedup * 1000, throttle * 1000)


def test_suppress_without_pause(spark):
    """A group that never pauses is many small chunks, and equals the simulation."""
    n, dedup, throttle = 5 * 86_400, 3600, 900
    df = spark.range(n).select(F.lit(0).alias("rule_no"), F.lit("g").alias("group_key"), F.concat(F.lit("k"), F.col("id") % 3).alias("dedup_key"),
                               (F.col("id") * 1000).alias("ts_ms"), F.lpad(F.col("id").cast("string"), 7, "0").alias("id"),
                               F.lit(dedup * 1000).cast("long").alias("dedup_ms"), F.lit(throttle * 1000).cast("long").alias("throttle_ms"))
    rows = [("g", f"k{i % 3}", i * 1000, f"{i:07d}") for i in range(n)]
    assert {r.id: r.disposition for r in folds.suppress(df).collect()} == simulate_suppress(rows, dedup * 1000, throttle * 1000)


def test_greedy_cover(spark):
    rng = random.Random(8)
    rows = [(k, t, life) for k, life in (("a", 1), ("b", 7), ("c", 5000), ("d", 10 ** 7)) for t in rng.choices(range(40_000), k=700)]
    kept, free = [], {}
    for k, t, life in sorted(set(rows)):
        if t >= free.get(k, 0):
            kept.append((k, t))
            free[k] = t + life
    got = folds.greedy_cover(spark.createDataFrame(rows, "key string, ts_ms long, life_ms long").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == kept


def test_notifications_live_an_hour(spark):
    from logweir.operators.notify import notify_dedup

    minutes = [("a", m) for m in (0, 0, 59, 60, 61, 119, 121, 300)] + [("b", 5)]
    df = spark.createDataFrame([(i, m, {"m": str(m)}) for i, m in minutes], "id string, m long, metadata map<string,string>")
    df = df.withColumn("created_at", F.timestamp_seconds(F.col("m") * 60)).select("id", "created_at", "m", "metadata")
    assert sorted((r.id, r.m, r.metadata["m"]) for r in notify_dedup(df).collect()) == \
        [("a", 0, "0"), ("a", 60, "60"), ("a", 121, "121"), ("a", 300, "300"), ("b", 5, "5")]


def test_sliding_count_with_ties(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), t, f"{i:05d}") for i, t in enumerate(random_times(rng, 1000, True))]
    df = spark.createDataFrame(rows, "key string, ms long, id string").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.id: r["count"] for r in
           sliding_count(df, F.col("key"), F.col("ts"), F.col("id"), 5).collect()}
    want = {}
    for key, t, i in rows:
        want[i] = sum(1 for k, u, j in rows if k == key and t - 5000 < u and (u, j) <= (t, i))
    assert got == want
    some = {r.id: r["count"] for r in
            sliding_count(df, F.col("key"), F.col("ts"), F.col("id"), 5, at_least=6).collect()}
    assert some == {i: c for i, c in want.items() if c >= 6}


def test_all_items_of_a_firing(spark):
    from logweir.streaming.folds import DistinctFold

    items = [f"10.0.0.{k}" for k in range(100, 125)]
    rows = spark.createDataFrame([("a", 1_700_000_000_000 + k, x) for k, x in enumerate(items)], "key string, ts_ms long, item string")
    for stored, want in ((None, items), (20, items[:20])):
        assert [r["items"] for r in folds.reset_fold(rows, 25, 60, distinct=True, stored=stored).collect()] == [want]
        fold, memory = DistinctFold(25, 60_000, stored=stored), {"items": {}}
        out = [fired for k, x in enumerate(items) for fired in fold.take(memory, Row(ts_ms=k, tie=x))]
        assert out[0][2] == want
    assert [r["items"] for r in folds.reset_fold(rows, 25, 60, distinct=True).collect()] == [items[:20]]
