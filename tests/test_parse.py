"""Every sample line against the fields stated for it."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir.operators.parse import dead_letters, header, parse_logs, pipeline_counts, to_ecs
from logweir.operators.parsers import DEFAULT_PARSERS, Parser, Pattern, register_parser
from logweir.plans.sample_logs import CONSTANTS, FIELDS, SAMPLES, UNREADABLE, expected

VALUES = {"ip": "203.0.113.9", "dst": "192.168.1.7", "mac": "aa:bb:cc:dd:ee:ff", "user": "bob", "port": "4022",
          "dport": "443", "k": "5", "sender": "10.255.0.1"}
RECEIVED = dt.datetime(2024, 3, 1, 12, 0, 0, 123456, tzinfo=dt.timezone.utc)


def fill(template):
    if template is None:
        return None
    for name, value in VALUES.items():
        template = template.replace("{%s}" % name, value)
    return template


def envelopes(spark, lines):
    return spark.createDataFrame([(str(i), raw, RECEIVED, "10.255.0.1") for i, raw in enumerate(lines)],
                                 "id string, raw string, received_at timestamp, source_ip string")


@pytest.fixture(scope="module")
def rows(spark):
    lines = [f"<134>Feb  3 04:05:06 gw {program}: {fill(text)}" for _, program, text, _ in SAMPLES]
    got = parse_logs(envelopes(spark, lines)).collect()
    return {int(r.id): r for r in got}


@pytest.mark.parametrize("number", range(len(SAMPLES)))
def test_sample(rows, number):
    row, parser = rows[number], SAMPLES[number][0]
    assert (row.parser or "") == parser
    if number >= len(SAMPLES) - UNREADABLE:
        assert row.parsed is None and row.reason == ("parse_failed" if parser else "no_parser")
        return
    assert row.reason is None
    p = row.parsed
    dataset, kind, _, observer, *_ = CONSTANTS[parser]
    assert (p.dataset, p.kind, p.observer, p.hostname) == (dataset, kind, observer, "gw")
    assert p.ts == dt.datetime(2024, 2, 3, 4, 5, 6)
    got = {name: p[name] for name in FIELDS}
    got["labels"] = ";".join(f"{k}={v}" for k, v in sorted(p.labels.items()))
    got["category"], got["tags"] = " ".join(p.category), " ".join(p.tags)
    got = {k: None if v is None else str(v) for k, v in got.items()}
    assert got == {name: fill(expected(number)[name]) for name in FIELDS}


def test_headers(spark):
    lines = ["2024-02-03T04:05:06.789+02:00 gw sshd - - - Failed password for a from 1.2.3.4 port 5 ssh2",
             "<34>1 2024-02-03T04:05:06Z gw sshd - - - Failed password for a from 1.2.3.4 port 5 ssh2",
             "<13>Dec 31 23:59:59 gw sshd: Failed password for a from 1.2.3.4 port 5 ssh2",
             "<13>Feb 30 01:00:00 gw sshd: Failed password for a from 1.2.3.4 port 5 ssh2",
             "Failed password for a from 1.2.3.4 port 5 ssh2"]
    got = {r.id: r.parsed for r in parse_logs(envelopes(spark, lines)).collect()}
    arrived = dt.datetime(2024, 3, 1, 12, 0, 0, 123000)
    assert [got[str(i)].ts for i in range(5)] == [
        dt.datetime(2024, 2, 3, 2, 5, 6, 789000), arrived, dt.datetime(2023, 12, 31, 23, 59, 59), arrived, arrived]
    assert [got[str(i)].hostname for i in range(5)] == ["gw", None, "gw", "gw", None]


def test_fallthrough_recovers_later_claimants(spark):
    lines = ["<1>Feb  3 04:05:06 gw kernel: Out of memory: Kill process 1 (init) score 1",
             "<1>Feb  3 04:05:06 gw dhclient: No DHCPOFFERS received"]
    strict = parse_logs(envelopes(spark, lines))
    assert {r.reason for r in dead_letters(strict).collect()} == {"parse_failed"}
    loose = {r.id: r for r in parse_logs(envelopes(spark, lines), fallthrough=True).collect()}
    assert loose["0"].parser == "system" and loose["1"].parsed.labels["wan_event"] == "dhcp_failure"


def test_precedence_is_fixed():
    assert [p.name for p in DEFAULT_PARSERS] == [
        "ids_ips", "threat", "firewall", "auth", "vpn", "wireless", "dhcp", "dns", "traffic", "wan", "port",
        "device", "admin", "system"]


def test_added_parser_takes_its_place(spark):
    mine = Parser(name="door", dataset="site.door", keywords="door opened", category="physical", severity=4,
                  predicate="contains(raw, 'door opened')",
                  patterns=(Pattern(r"door opened by (\S+)", "who", message="door: {who}", fields={"user": "{who}"}),))
    parsers = register_parser(DEFAULT_PARSERS, mine, 0)
    row = parse_logs(envelopes(spark, ["Failed password; door opened by eve"]), parsers).collect()[0]
    assert (row.parser, row.parsed.user, row.parsed.message) == ("door", "eve", "door: eve")
    with pytest.raises(ValueError):
        register_parser(parsers, mine, 1)


def test_counts_and_ecs(spark):
    parsed = parse_logs(envelopes(spark, [
        "<1>Feb  3 04:05:06 gw sshd: Failed password for a from 1.2.3.4 port 5 ssh2",
        "<1>Feb  3 04:05:06 gw kernel: hello", "noise"]))
    assert {(r.dataset, r.status, r.n) for r in pipeline_counts(parsed).collect()} == {
        ("unifi.auth", "success", 1), ("unifi.firewall", "failed", 1), ("unrecognized", "dead_letter", 1)}
    event = to_ecs(parsed).select("event.action", "source.threat_intel.matched", "observer.vendor").collect()[0]
    assert tuple(event) == ("denied", False, "Ubiquiti")
    assert to_ecs(parsed, compat=False).select("event.action").collect()[0][0] is None
    assert to_ecs(parsed).filter(F.col("event.id") == "0").count() == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_by_log_type_goes_before_the_reading(spark):
    parsed = parse_logs(envelopes(spark, ["x"])).filter((F.col("parser") == "wan") & F.col("reason").isNull())
    steps = plan_of(parsed).splitlines()
    read = next(i for i, step in enumerate(steps) if "Generate" in step and "[pattern_no#" in step)
    assert any("Filter" in step and "= wan)" in step for step in steps[read + 1:])


def test_only_lines_that_are_asked_for_are_taken_apart(spark):
    for rows in (dead_letters(parse_logs(envelopes(spark, ["x"]))), to_ecs(parse_logs(envelopes(spark, ["x"])))):
        steps = plan_of(rows).splitlines()
        apart = next(i for i, step in enumerate(steps) if "Generate" in step and "[found#" in step)
        read = next(i for i, step in enumerate(steps) if "Generate" in step and "[pattern_no#" in step)
        assert any("Filter" in step and "pattern_no#" in step for step in steps[apart + 1:read])


def test_a_header_is_cut_out_once(spark):
    rows = envelopes(spark, ["x"]).select(header(F.col("raw"), F.col("received_at")).alias("h"))
    assert plan_of(rows).count("regexp_replace(") == 1
