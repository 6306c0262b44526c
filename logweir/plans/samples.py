"""Dimensions and alerts derived from the driver tables."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import ip_to_long
from ..operators import detect, rules, search
from ..sources import feeds

# The sample events are sparse (some fourteen an hour), so windows are days and thresholds small.
DAY = 86_400
THRESHOLDS = {"multiple_failed_logins": 3, "vpn_auth_failures": 2, "critical_firewall_event": 3}


def tuned(rule: rules.Rule) -> rules.Rule:
    """A shipped rule with a window the sample events can fill."""
    condition = replace(rule.condition, window_seconds=rule.condition.window_seconds * 288,
                        threshold=THRESHOLDS.get(rule.id, rule.condition.threshold))
    return replace(rule, condition=condition)


TUNED_RULES = [tuned(r) for r in rules.SHIPPED_RULES]


# Windows without common factors.
MIXED_RULES = [replace(r, condition=replace(r.condition, window_seconds=288 * w))
               for r, w in zip(TUNED_RULES, (61, 67, 71, 73, 79, 83, 300))]


def geo_ranges(nation: DataFrame) -> DataFrame:
    """One /24 per nation."""
    key = F.col("n_nationkey")
    base = F.concat(F.lit("81.2."), key.cast("string"), F.lit(".0"))
    return nation.select(ip_to_long(base).alias("lo"), (ip_to_long(base) + 255).alias("hi"),
                         F.concat(F.lit("C"), key.cast("string")).alias("country_iso_code"),
                         F.col("n_name").alias("country_name"), F.lit(None).cast("string").alias("city_name"),
                         (key * 3.0 - 36).alias("lat"), (key * 7.0 - 84).alias("lon"))


def geo_of_both(nation: DataFrame) -> DataFrame:
    """One IPv4 /24 and one IPv6 /48 per nation; even ones have the IPv6 network cut in two."""
    key = F.col("n_nationkey").cast("string")
    four, six = F.concat(F.lit("81.2."), key, F.lit(".0/24")), F.concat(F.lit("2a00:"), key)
    networks = F.when(F.col("n_nationkey") % 2 == 1, F.array(four, F.concat(six, F.lit("::/48")))).otherwise(
        F.array(four, F.concat(six, F.lit("::/49")), F.concat(six, F.lit(":0:8000::/49"))))
    return feeds.geo_networks(nation.select(F.explode(networks).alias("network"), F.concat(F.lit("C"), key).alias("country_iso_code"),
                                            F.col("n_name").alias("country_name"), F.lit(None).cast("string").alias("city_name"),
                                            (F.col("n_nationkey") * 3.0 - 36).alias("lat"), (F.col("n_nationkey") * 7.0 - 84).alias("lon")))


# Address text of a sample event in IPv6 for every third one; the same text runs on both engines.
SIX_IP = ("CASE WHEN public AND k % 3 = 0 THEN concat('2A00:', cast(geo_no AS {str}), ':0:', CASE WHEN k % 2 = 0 THEN '0' ELSE '9001' END, '::', "
          "cast(oct4 AS {str})) WHEN NOT public AND k % 3 = 0 THEN concat('fe80::', cast(oct4 AS {str})) ELSE source_ip END")


# The same text runs on both engines: a line of a block list per supplier.
FEED_LINE = ("CASE WHEN s_suppkey % 11 = 0 THEN concat('# note ', cast(s_suppkey AS {str})) "
             "WHEN s_suppkey % 7 = 0 THEN concat('81.2.', cast(s_suppkey % 25 AS {str}), '.', cast(s_suppkey % 8 AS {str}), '/', "
             "cast(29 + s_suppkey % 4 AS {str}), ' ; block') "
             "WHEN s_suppkey % 13 = 0 THEN concat('host', cast(s_suppkey AS {str}), '.example') "
             "WHEN s_suppkey % 3 = 0 THEN concat('81.2.', cast(s_suppkey % 25 AS {str}), '.', cast(1 + s_suppkey % 4 AS {str}), "
             "' # seen') ELSE concat('198.18.0.', cast(s_suppkey % 250 AS {str})) END")
FEED_NAME = "CASE s_suppkey % 3 WHEN 0 THEN 'feodo' WHEN 1 THEN 'blocklist_de' ELSE 'spamhaus_drop' END"


def feed_lines(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.expr(FEED_NAME).alias("feed"), F.col("s_suppkey").alias("line_no"),
                           F.expr(FEED_LINE.format(str="string")).alias("line"))


def alerts(events: DataFrame) -> DataFrame:
    """Alerts of the two detectors that fire on every sample."""
    found = detect.admin_off_hours(events).unionByName(detect.rogue_device(events))
    return search.with_ack_columns(found)


def acks(alert_rows: DataFrame) -> DataFrame:
    """Two acknowledgements of every alert raised in the first half of an hour."""
    early = alert_rows.filter(F.minute("created_at") < 30)
    return early.select(F.col("id").alias("alert_id"), F.explode(F.array(
        F.struct(F.lit("ann").alias("user_id"), (F.col("created_at") + F.expr("interval 2 minutes")).alias("at")),
        F.struct(F.lit("bob").alias("user_id"), (F.col("created_at") + F.expr("interval 1 minute")).alias("at")),
    )).alias("a")).select("alert_id", "a.user_id", "a.at")
