"""Cleaning, feeds, dimensions, tables, sinks and lookups."""
import datetime as dt
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from logweir.functions.network import cidr_bounds, ip_to_long, is_non_routable, is_private, normalize_mac
from logweir.operators import dashboard, enrich, notify, requests as req, search
from logweir.plans import samples
from logweir.plans.sample_events import events_as_ecs, read
from logweir.schema import ALERT_COLUMNS
from logweir.sources import feeds, raw_logs, store
from logweir.streaming.jobs import deliver


def test_clean_and_envelope(spark):
    rows = [(bytearray(b" plain\x00 \n"),), (bytearray("é".encode()),), (bytearray(b"caf\xe9"),), (bytearray(b" \x00 "),)]
    df = raw_logs.clean_raw(spark.createDataFrame(rows, "raw binary"))
    assert [r.raw for r in df.collect()] == ["plain", "é", "café"]
    env = raw_logs.envelope(df, F.lit(dt.datetime(2024, 1, 1, 0, 0, 0, 123456)), F.lit("1.2.3.4"))
    first = env.collect()
    assert first == env.collect() and len({r.id for r in first}) == 3
    assert first[0].received_at.microsecond == 123000


def test_decode_sets_bad_rows_aside(spark, sf_dir):
    events = events_as_ecs(read(spark, sf_dir, "events").filter("event_id < 3"))
    text = raw_logs.encode_events(events).unionByName(spark.createDataFrame([("{bad",), ("[1",)], "event string"))
    good, bad = raw_logs.decode_events(text)
    assert good.count() == 3 and bad.count() == 2
    assert {r.id for r in good.select("event.id").collect()} == {r.id for r in events.select("event.id").collect()}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "b_list.txt").write_text("# head\n; also\n1.2.3.4 # seen\n10.1.0.5/16\nhost.example\n 5.6.7.8;x\n300.1.1.0/24\n")
    (tmp_path / "a_list.txt").write_text("1.2.3.4\r\n10.1.2.0/24\n")
    (tmp_path / "c.json").write_text(json.dumps({"7": [{"url": "http://9.9.9.9:80/x"}], "8": [{"url": "https://h.example/"}]}))
    (tmp_path / "d.csv").write_text("# c\n4.4.4.4,443,why\n")
    return str(tmp_path)


def test_feeds(spark, folder):
    lines = feeds.read_feed_plain(spark, folder)
    assert {(r.feed, r.line_no) for r in lines.collect() if r.line} == {("a_list", 0), ("a_list", 1), *(("b_list", k) for k in range(7))}
    entries = feeds.feed_entries(lines)
    assert {tuple(r) for r in feeds.feed_ips(entries).collect()} == {("1.2.3.4", "a_list"), ("5.6.7.8", "b_list")}
    blocks = feeds.feed_cidrs(entries)
    assert {(r.lo, r.feed) for r in blocks.collect()} == {
        (int(ipaddress.ip_address("10.1.0.0")), "b_list"), (int(ipaddress.ip_address("10.1.2.0")), "a_list")}
    ips = spark.createDataFrame([("1.2.3.4",), ("10.1.2.9",), ("10.1.9.9",), ("8.8.8.8",), (None,), ("x",)], "ip string")
    for limit in (0, 10):
        got = enrich.match_ip_cidr(ips, blocks, "ip", limit=limit).collect()
        assert {(r.ip, r.block.feed if r.block else None) for r in got} == {
            ("1.2.3.4", None), ("10.1.2.9", "a_list"), ("10.1.9.9", "b_list"), ("8.8.8.8", None), (None, None), ("x", None)}
    full = {r.ip: tuple(r.threat_intel) for r in enrich.enrich_threat(ips, feeds.feed_ips(entries), blocks, "ip").collect()}
    assert full["1.2.3.4"] == (True, "a_list", 90) and full["10.1.9.9"] == (True, "b_list", 85)
    assert full["8.8.8.8"] == full[None] == (False, None, 0)
    assert {r.line for r in feeds.read_feed_json(spark, f"{folder}/c.json").collect()} == {"9.9.9.9", "h.example"}
    assert [(r.line, r.detail) for r in feeds.read_feed_csv(spark, f"{folder}/d.csv", "csv_ip_port", "sslbl").collect()] == [("4.4.4.4", "443")]


CATALOG = """
feeds:
  - {name: one, format: plain_ip, local_path: /x/a_list.txt, update_interval_hours: 6, enabled: true, tags: [botnet], confidence: high}
  - {name: two, format: csv_ip_port, local_path: /x/d.csv, tags: [c2], confidence: medium}
  - {name: three, format: urlhaus_json, local_path: /x/c.json, update_interval_hours: 2, tags: [], confidence: low}
  - {name: disabled, format: plain_cidr, local_path: /x/b_list.txt, enabled: false}
  - {name: gone, format: plain_cidr, local_path: /x/none.txt}
"""


def test_catalogue_steers_the_readers(spark, folder, tmp_path):
    (tmp_path / "feeds.yml").write_text(CATALOG)
    catalog = feeds.load_feed_catalog(spark, f"{folder}/feeds.yml")
    assert [tuple(r) for r in catalog.select("name", "feed", "update_interval_hours", "confidence").collect()] == [
        ("one", "a_list", 6, "high"), ("two", "d", None, "medium"), ("three", "c", 2, "low"), ("gone", "none", None, None)]
    entries = feeds.feed_entries(feeds.read_catalog_feeds(spark, catalog, folder))
    assert {tuple(r) for r in feeds.feed_ips(entries).collect()} == {("1.2.3.4", "a_list"), ("4.4.4.4", "d"), ("9.9.9.9", "c")}
    ips = spark.createDataFrame([("4.4.4.4",), ("9.9.9.9",), ("5.6.7.8",)], "ip string")
    found = enrich.with_feed_details(enrich.enrich_threat(ips, feeds.feed_ips(entries), feeds.feed_cidrs(entries), "ip").select("ip", "threat_intel.feed"), catalog)
    assert {(r.ip, r.feed, r.confidence) for r in found.collect()} == {("4.4.4.4", "d", "medium"), ("9.9.9.9", "c", "low"), ("5.6.7.8", None, None)}
    (tmp_path / "bad.yml").write_text("feeds: [{name: x, format: xml, local_path: a}]")
    with pytest.raises(ValueError):
        feeds.load_feed_catalog(spark, f"{folder}/bad.yml")


def test_nested_blocks_against_every_pair(spark):
    rng = random.Random(5)
    blocks = [(f"10.{rng.randrange(3)}.{rng.randrange(256)}.0/{rng.choice([8, 14, 16, 20, 24, 26, 32])}", f"f{rng.randrange(4)}", i)
              for i in range(60)]
    ips = [f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(400)] + ["11.0.0.1"]
    lo, hi, length = cidr_bounds("c")
    table = spark.createDataFrame(blocks, "c string, feed string, n int").select(
        lo.alias("lo"), hi.alias("hi"), length.alias("length"), "feed", F.struct("feed", "n").alias("ord"))
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.block.feed if r.block else None for r in enrich.match_ip_cidr(df, table, "ip").collect()}
    for ip in ips:
        hits = [(f, n) for c, f, n in blocks if ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False)]
        assert got[ip] == (min(hits)[0] if hits else None)


def test_ip_functions(spark):
    rng = random.Random(2)
    ips = [str(ipaddress.ip_address(rng.randrange(2 ** 32))) for _ in range(300)] + [
        "10.1.1.1", "100.64.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.9", "198.51.100.7", "203.0.113.1", "::1",
        "fe80::1", "fd00::2", "2606:4700::1", "256.1.1.1", "1.2.3", "x", ""]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select(
        "ip", ip_to_long("ip").alias("n"), is_private("ip").alias("p"), is_non_routable("ip").alias("s")).collect()
    skip = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                                             "169.254.0.0/16", "100.64.0.0/10", "::1/128", "fc00::/7", "fe80::/10")]
    for r in rows:
        try:
            ip = ipaddress.ip_address(r.ip)
        except ValueError:
            assert (r.n, r.p, r.s) == (None, False, True), r
            continue
        assert r.n == (int(ip) if ip.version == 4 else None), r
        assert r.p == ip.is_private and r.s == any(ip in n for n in skip if n.version == ip.version), r


def test_oui_prefers_downloaded_and_normalises(spark, tmp_path):
    (tmp_path / "oui.json").write_text(json.dumps([{"macPrefix": "b8:27:eb", "vendorName": "New Name"}, {"macPrefix": "", "vendorName": "x"}]))
    oui = feeds.read_oui(spark, str(tmp_path / "oui.json"))
    macs = spark.createDataFrame([("B8-27-EB-00-00-01",), ("dc:a6:32:00:00:01",), ("ffff.0000.1111",)], "mac string")
    assert {r.mac: r.v for r in enrich.enrich_mac_vendor(macs, oui, "mac", "v").collect()} == {
        "B8-27-EB-00-00-01": "New Name", "dc:a6:32:00:00:01": "Raspberry Pi Foundation", "ffff.0000.1111": None}
    assert macs.select(normalize_mac("mac")).collect()[0][0] == "b8:27:eb:00:00:01"


def test_event_table_days_and_expiry(spark, sf_dir, tmp_path):
    events, path = events_as_ecs(read(spark, sf_dir, "events")), str(tmp_path / "events")
    store.write_events(events, path, batch_id=1)
    store.write_events(events, path, batch_id=1)
    stored = store.read_events(spark, path)
    assert stored.count() == events.count()
    day = search.prune_days(stored, dt.datetime(2024, 1, 5, 23), dt.datetime(2024, 1, 6, 1))
    assert {str(r.event_date) for r in day.select("event_date").distinct().collect()} == {"2024-01-05", "2024-01-06"}
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().toString()
    for bounds in ({"to_ts": dt.datetime(2024, 1, 31)}, {"from_ts": dt.datetime(2024, 1, 15)}, {}):
        pruned, plain = (search.matching_logs(e, **bounds).count() for e in (stored, stored.drop("event_date")))
        assert pruned == plain == search.matching_logs(events, **bounds).count()
    top = dashboard.top_source_ips(stored, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))
    assert "PartitionFilters: [isnotnull(event_date" in top._jdf.queryExecution().toString()
    dropped = store.drop_expired(spark, path, dt.date(2024, 4, 3))
    assert dropped == ["event_date=2024-01-01", "event_date=2024-01-02", "event_date=2024-01-03", "event_date=2024-01-04"]


def test_alert_table_is_idempotent_and_sinks_are_isolated(spark, sf_dir, tmp_path):
    alerts = samples.alerts(events_as_ecs(read(spark, sf_dir, "events"))).select(
        "id", "rule_id", "rule_name", "severity", "title", "description", "created_at", "event_count", "metadata")
    path, live, bare = str(tmp_path / "alerts"), [], []
    sinks = {"store": lambda a: store.write_alerts(a, path), "down": lambda a: 1 / 0,
             "live": lambda a: live.extend(notify.alert_envelope(a).collect()),
             "notify": lambda a: bare.extend(notify.alert_payload(a).collect())}
    for _ in range(2):
        assert set(deliver(alerts, sinks)) == {"down"}
    assert spark.read.parquet(path).count() == alerts.count() == len(bare) // 2
    assert {r.id for r in live} == {json.loads(r.value)["id"] for r in bare}
    with pytest.raises(ZeroDivisionError):
        deliver(alerts, sinks, required=("down",))


def test_first_acknowledgement_wins(spark, sf_dir):
    alerts = samples.alerts(events_as_ecs(read(spark, sf_dir, "events")))
    once = search.acknowledge(alerts, samples.acks(alerts))
    again = search.acknowledge(once, samples.acks(alerts).withColumn("user_id", F.lit("zoe")))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    with pytest.raises(ValueError):
        search.list_alerts(alerts, 1, 500)


def test_stored_acknowledgements(spark, sf_dir, tmp_path):
    """Two acks, a retry and a later one agree; files of other days are not touched."""
    alerts = samples.alerts(events_as_ecs(read(spark, sf_dir, "events"))).select(*ALERT_COLUMNS).persist()
    path = str(tmp_path / "alerts")
    store.write_alerts(alerts, path)
    files = lambda: {(p, p.stat().st_mtime_ns) for p in (tmp_path / "alerts").glob("alert_date=*/*.parquet")}
    before, chosen = files(), alerts.orderBy("created_at").limit(3)
    acks = samples.acks(chosen.withColumn("created_at", F.col("created_at") - F.make_dt_interval(mins=F.minute("created_at"))))
    days = store.acknowledge_stored(spark, path, acks)
    touched = {f"alert_date={d}" for d in days}
    assert days and {x for x in before if x[0].parent.name not in touched} <= files()
    once = sorted(map(str, store.read_alerts(spark, path).select(sorted(store.STORED_ALERT.fieldNames())).collect()))
    assert store.acknowledge_stored(spark, path, acks.withColumn("user_id", F.lit("zoe"))) == []
    again = store.read_alerts(spark, path)
    assert sorted(map(str, again.select(sorted(store.STORED_ALERT.fieldNames())).collect())) == once
    assert again.count() == alerts.count() and {r.acknowledged_by for r in again.filter("acknowledged").collect()} == {"bob"}
    assert again.filter("acknowledged").count() == 3
    store.write_alerts(alerts, path)
    assert store.read_alerts(spark, path).count() == alerts.count()


def test_files_of_a_day_and_lookup_of_an_id(spark, sf_dir, tmp_path):
    events, path = events_as_ecs(read(spark, sf_dir, "events")), str(tmp_path / "events")
    store.write_events(events.repartition(40), path)
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "events").glob("event_date=*")) <= 2
    stored = store.read_events(spark, path)
    known = stored.select("event.id").first()[0]
    assert search.get_event(stored, known).count() == 1

    def rows_read(event_id):
        df = stored.filter(F.col("event.id") == event_id).select("ts")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value()
    assert rows_read("no-such-id") == 0 and 0 < rows_read(known) < stored.count() / 4


def test_request_functions(spark):
    rows = spark.createDataFrame([("POST", "/api/v1/users/", "1.1.1.1, 2.2.2.2", "9.9.9.9"), ("PATCH", "/", "", "9.9.9.9"),
                                  ("HEAD", "/x", None, None)], "m string, p string, x string, peer string")
    got = rows.select(req.derive_action(F.col("m"), F.col("p")), req.client_ip(F.col("x"), F.col("peer"))).collect()
    assert [tuple(r) for r in got] == [("create:users", "1.1.1.1"), ("update:unknown", "9.9.9.9"), ("head:x", "unknown")]


def test_tables_read_in_few_parts_are_dealt_out(spark):
    from logweir.plans.sample_events import spread
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 4 * cores)
    assert spread(few).rdd.getNumPartitions() == cores and spread(many).rdd.getNumPartitions() == 4 * cores
