"""Predicates, rule loading and templates."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir.functions.predicates import matches
from logweir.functions.text import format_bytes, render
from logweir.operators import rules
from logweir.operators.detect import DEFAULT_DETECTORS, correlate, register_rule, rogue_device
from logweir.plans.sample_events import events_as_ecs, read


@pytest.fixture(scope="module")
def event(spark):
    return spark.sql("""SELECT named_struct('ip', '203.0.113.10') AS source, named_struct('outcome', 'failure', 'count', 51)
        AS event, named_struct('command_line', 'C:\\\\powershell.exe -enc AB') AS process,
        named_struct('bytes', 'not-a-number') AS network, named_struct('matched', true) AS threat,
        map('ssid', 'lab') AS labels""")


@pytest.mark.parametrize("operator,path,value,hit", [
    ("eq", "event.outcome", "failure", True), ("eq", "event.outcome", "success", False),
    ("eq", "no.such", "x", False), ("eq", "no.such", "None", True), ("ne", "no.such", "x", True),
    ("eq", "threat.matched", "True", True), ("eq", "labels.ssid", "lab", True),
    ("ne", "event.outcome", "failure", False), ("ne", "event.outcome", "success", True),
    ("gt", "event.count", 50, True), ("gt", "event.count", 51, False), ("gte", "event.count", 51, True),
    ("lt", "event.count", 52, True), ("lt", "event.count", 51, False), ("lte", "event.count", 51, True),
    ("lte", "event.count", 50, False), ("gte", "network.bytes", 1, False), ("lt", "network.bytes", 1, False),
    ("gt", "event.count", "many", False), ("gt", "no.such", 1, False),
    ("contains", "process.command_line", "powershell", True), ("contains", "process.command_line", "bash", False),
    ("contains", "no.such", "x", False), ("regex", "source.ip", r"^203\.0\.\d+\.\d+$", True),
    ("regex", "source.ip", r"^10\.", False), ("regex", "source.ip", "(unclosed", False),
    ("regex", "source.ip", r"(?P<a>203)", True)])
def test_predicate(event, operator, path, value, hit):
    assert event.select(matches(event, path, operator, value)).collect()[0][0] is hit


def test_bad_operator_lists_the_valid_ones():
    with pytest.raises(ValueError, match="contains.*regex"):
        rules.Condition("a", "b", 1, 1, operator="like")


def test_shipped_rules():
    assert len(rules.SHIPPED_RULES) == 7
    spike = rules.rule_by_id("bandwidth_spike").condition
    assert (spike.operator, spike.value) == ("gte", 1073741824)
    assert rules.rule_by_id("vpn_auth_failures").condition.threshold == 5
    assert not {r.id for r in rules.SHIPPED_RULES} & set(DEFAULT_DETECTORS)


def test_rules_file(tmp_path):
    path = tmp_path / "rules.yml"
    path.write_text("""rules:
  - {id: a, name: A, severity: low, dedup_key: "a:{source.ip}", dedup_ttl_seconds: 60, throttle_seconds: 60,
     title_template: "t", body_template: "b", condition: {field: f, group_by: source.ip, threshold: 1, window_seconds: 60}}
""")
    loaded = rules.load_rules_file(str(path))
    assert loaded[0].condition.operator == "eq" and loaded[0].dataset_filter == []
    with pytest.raises((KeyError, TypeError)):
        rules.load_rules([{"id": "x"}])


def test_render(event):
    text = "{source.ip} {no.such} {destination.ip} {event_count} {network.bytes}"
    got = event.select(render(event, text, {"event_count": F.lit(7)})).collect()[0][0]
    assert got == "203.0.113.10 {no.such} unknown 7 not-a-number"


@pytest.mark.parametrize("n,text", [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"),
                                    (10 * 1024, "10 KB"), (1073741824, "1 GB"), (5 * 1024 ** 4 + 1024 ** 3 * 256, "5.25 TB")])
def test_format_bytes(spark, n, text):
    assert spark.range(1).select(format_bytes(F.lit(n))).collect()[0][0] == text


def test_metadata_prefers_the_event(event):
    df = event.withColumn("metadata", F.create_map(F.lit("source_ip"), F.lit("own"), F.lit("x"), F.lit("y")))
    assert df.select(rules.alert_metadata(df)).collect()[0][0] == {"source_ip": "own", "x": "y"}


def test_empty_dataset_filter_and_dedup_on_count(spark, sf_dir):
    events = events_as_ecs(read(spark, sf_dir, "events"))
    rule = rules.Rule(id="r", name="R", severity="low", dedup_key="k:{event_count}", dedup_ttl_seconds=60,
                      throttle_seconds=0, title_template="{event_count}", body_template="",
                      condition=rules.Condition("event.outcome", "user.name", 2, 86400))
    alerts = rules.evaluate_rules(events, [rule]).collect()
    assert alerts and {a.title for a in alerts} == {str(a.event_count) for a in alerts}


def test_detector_set_is_open_and_isolated(spark, sf_dir):
    events = events_as_ecs(read(spark, sf_dir, "events"))

    def broken(df):
        raise RuntimeError("no")
    detectors = register_rule({"rogue_device": rogue_device}, "again", "Again", "low", rogue_device)
    detectors = register_rule(detectors, "broken", "Broken", "low", broken)
    failures = {}
    got = correlate(events, detectors, failures)
    assert {r.rule_id for r in got.collect()} == {"rogue_device", "again"} and set(failures) == {"broken"}
    with pytest.raises(ValueError):
        register_rule(detectors, "again", "", "low", broken)
