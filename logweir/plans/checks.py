"""ANSI SQL for each query, run by another engine on the same tables.

The SQL is written from the meaning of each operator, not from its Spark plan:
folds are plain row-by-row recursions, block matches compare every block.
"""
from __future__ import annotations

from .catalog import KNOWN_ALERT, SEARCH_WORDS
from .sample_events import duckdb_flat, duckdb_requests
from .sample_logs import FIELDS, CONSTANTS, duckdb_expected
from .samples import DAY, FEED_LINE, FEED_NAME, MIXED_RULES, SIX_IP, TUNED_RULES

ECS = f"ecs AS ({duckdb_flat()})"
RANGE = "event_ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


_SECOND = _iso("date_trunc('second', event_ts)")


def _over_ecs(body: str) -> str:
    return f"WITH {ECS} {body}"


def _histogram(unit: str, where: str, measures: dict[str, str]) -> str:
    got = ", ".join(f"{e} AS {n}" for n, e in measures.items())
    out = ", ".join(f"cast(coalesce({n}, 0) AS BIGINT) AS {n}" for n in measures)
    return _over_ecs(f"""
        , spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 {unit})) AS b),
        got AS (SELECT date_trunc('{unit}', event_ts) AS b, {got} FROM ecs WHERE {RANGE} AND {where} GROUP BY 1)
        SELECT {_iso('spine.b')} AS bucket, {out} FROM spine LEFT JOIN got ON spine.b = got.b""")


ADMIN = """SELECT sha256(concat('admin_abuse|', id)) AS id, 'admin_abuse' AS rule_id, 'medium' AS severity,
    concat('Off-Hours Admin Access by ', user_name) AS title,
    concat('Admin activity detected outside business hours (06:00–22:00 UTC). User: ', user_name, ', IP: ', source_ip,
           ', Hour: ', lpad(cast(hour(event_ts) AS VARCHAR), 2, '0'), ':xx UTC.') AS description,
    event_ts AS created_at, 1 AS event_count, source_ip
    FROM ecs WHERE dataset = 'unifi.admin' AND (hour(event_ts) < 6 OR hour(event_ts) >= 22)"""


def _rogue(where: str = "true") -> str:
    return f"""SELECT sha256(concat('rogue_device|', mac)) AS id, 'rogue_device' AS rule_id, 'high' AS severity,
    concat('Rogue Device: ', mac) AS title,
    concat('Unknown MAC address ', mac, ' (IP: ', source_ip, ') observed on the network for the first time.') AS description,
    event_ts AS created_at, 1 AS event_count, source_ip
    FROM (SELECT *, row_number() OVER (PARTITION BY mac ORDER BY event_ts, id) AS rn FROM ecs)
    WHERE rn = 1 AND {where}"""


VPN = """SELECT sha256(concat('vpn_anomaly|', f.user_name, '|', f.country_iso_code, '|', f.id)) AS id,
    'vpn_anomaly' AS rule_id, 'medium' AS severity,
    concat('VPN Geo-Anomaly: ', f.user_name, ' from ', f.country_name) AS title,
    concat('User ''', f.user_name, ''' connected via VPN from a new country: ', f.country_name, ' (', f.country_iso_code,
           '). Previously seen countries: ', string_agg(g.country_iso_code, ', ' ORDER BY g.country_iso_code), '.') AS description,
    f.event_ts AS created_at, 1 AS event_count, f.source_ip
    FROM firsts f JOIN firsts g ON f.user_name = g.user_name AND g.event_ts < f.event_ts
    GROUP BY f.id, f.user_name, f.country_iso_code, f.country_name, f.event_ts, f.source_ip"""
FIRSTS = """firsts AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_name, country_iso_code ORDER BY event_ts, id) AS rn FROM ecs
    WHERE dataset = 'unifi.vpn' AND type = 'start' AND user_name IS NOT NULL AND country_iso_code IS NOT NULL)
    WHERE rn = 1)"""

ALERTS = f"alerts AS ({ADMIN} UNION ALL {_rogue()})"
ACKS = """acked AS (SELECT id AS ack_id, created_at + INTERVAL 1 MINUTE AS ack_at FROM alerts WHERE minute(created_at) < 30)"""
FLAT = f"id, rule_id, severity, title, description, {_iso('created_at')} AS created_at, event_count"
EVENT = f"id, {_iso('event_ts')} AS ts, dataset, source_ip, severity"


def _over_alerts(body: str) -> str:
    return f"WITH {ECS}, {ALERTS}, {ACKS} {body}"


def _recursive(rows: str, state: str, start: str, step: str, fired: str, out: str) -> str:
    """Row-by-row fold: ``rows`` has g, rn, t and more; ``start`` and ``step`` give ``state`` after a row."""
    return f"""WITH RECURSIVE {ECS}, ordered AS ({rows}),
        walk AS (SELECT g, rn, {start} FROM ordered WHERE rn = 1
                 UNION ALL SELECT o.g, o.rn, {step} FROM walk w JOIN ordered o ON o.g = w.g AND o.rn = w.rn + 1)
        SELECT {out} FROM walk JOIN ordered USING (g, rn) WHERE {fired}"""


def _brute(window: int, n: int) -> str:
    rows = """SELECT source_ip AS g, epoch_ms(event_ts) AS t, event_ts,
        row_number() OVER (PARTITION BY source_ip ORDER BY event_ts, id) AS rn
        FROM ecs WHERE outcome = 'failure' AND category LIKE '%authentication%'"""
    queue = f"list_append(list_filter(CASE WHEN len(w.q) >= {n} THEN CAST([] AS BIGINT[]) ELSE w.q END, lambda x: x > o.t - {window * 1000}), o.t)"
    return _recursive(rows, "q", "[t] AS q", f"{queue}", f"len(q) >= {n}",
                      f"g AS source_ip, {_iso('event_ts')} AS created_at, {n} AS event_count, concat('Brute Force: ', g) AS title")


def _scan(window: int, n: int) -> str:
    rows = f"""SELECT concat(source_ip, '/', cast(epoch_ms(event_ts) // {window * 1000} AS VARCHAR)) AS g, source_ip, event_ts,
        dest_port AS p, row_number() OVER (PARTITION BY source_ip, epoch_ms(event_ts) // {window * 1000} ORDER BY event_ts, id) AS rn
        FROM ecs"""
    ports = f"list_distinct(list_append(CASE WHEN len(w.q) >= {n} THEN CAST([] AS BIGINT[]) ELSE w.q END, o.p))"
    return _recursive(rows, "q", "CAST([p] AS BIGINT[]) AS q", ports, f"len(q) >= {n}",
                      f"source_ip, {_iso('event_ts')} AS created_at, {n} AS event_count, concat('Port Scan: ', source_ip) AS title")


def _lateral(window: int, n: int) -> str:
    rows = """SELECT source_ip AS g, epoch_ms(event_ts) AS t, event_ts, dest_ip AS d,
        row_number() OVER (PARTITION BY source_ip ORDER BY event_ts, id) AS rn FROM ecs WHERE source_ip LIKE '10.%'"""
    kind = "STRUCT(t BIGINT, d VARCHAR)[]"
    seen = (f"list_append(list_filter(CASE WHEN len(w.q) >= {n} THEN CAST([] AS {kind}) ELSE w.q END, "
            f"lambda x: x.t > o.t - {window * 1000} AND x.d <> o.d), {{'t': o.t, 'd': o.d}})")
    return _recursive(rows, "q", f"CAST([{{'t': t, 'd': d}}] AS {kind}) AS q", seen, f"len(q) >= {n}",
                      f"""g AS source_ip, {_iso('event_ts')} AS created_at, {n} AS event_count,
                      concat('["', array_to_string(list_transform(q, lambda x: x.d), '","'), '"]') AS destinations""")


SQL_CONDITIONS = {
    "multiple_failed_logins": ("dataset IN ('unifi.auth', 'unifi.ids_ips') AND outcome = 'failure'", "source_ip", "''"),
    "threat_management_trigger": ("dataset IN ('unifi.ids_ips', 'unifi.threat') AND kind = 'alert'", "source_ip", "''"),
    "rogue_ap_detection": ("dataset = 'unifi.wireless' AND action = 'rogue_ap_detected'", "coalesce(ssid, 'unknown')", "mac"),
    "vpn_auth_failures": ("dataset = 'unifi.vpn' AND outcome = 'failure'", "source_ip", "user_name"),
    "bandwidth_spike": ("dataset = 'unifi.traffic' AND bytes >= 1073741824", "source_ip", "''"),
    "device_offline": ("dataset = 'unifi.device' AND action = 'device.disconnected'", "hostname", "''"),
    "critical_firewall_event": ("dataset = 'unifi.firewall' AND action = 'denied'", "source_ip", "''"),
}
SQL_TITLES = {
    "multiple_failed_logins": "concat('Brute Force Detected from ', source_ip)",
    "threat_management_trigger": "concat('IDS/IPS Alert: Threat Management Alert from ', source_ip)",
    "rogue_ap_detection": "concat('Rogue AP Detected: SSID ''', ssid, ''' from ', mac)",
    "vpn_auth_failures": "concat('VPN Anomaly: ', cast(c AS VARCHAR), ' failures from ', source_ip, ' for user ', user_name)",
    "bandwidth_spike": "concat('Bandwidth Spike: ', source_ip, ' transferred ', human, ' in 5 min')",
    "device_offline": "concat('UniFi Device Offline: ', hostname, ' (firewall)')",
    "critical_firewall_event": "concat('Firewall: Port Scan Detected from ', source_ip, ' (', cast(c AS VARCHAR), ' blocked)')",
}
HUMAN = """CASE WHEN bytes >= 1073741824 THEN concat(regexp_replace(cast(cast(round(bytes / 1073741824.0, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', ''), ' GB')
    WHEN bytes >= 1048576 THEN concat(regexp_replace(cast(cast(round(bytes / 1048576.0, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', ''), ' MB')
    WHEN bytes >= 1024 THEN concat(regexp_replace(cast(cast(round(bytes / 1024.0, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', ''), ' KB')
    WHEN bytes >= 1 THEN concat(cast(bytes AS VARCHAR), ' B') ELSE '0 B' END"""


def _candidates(rule, number: int) -> str:
    where, group, key = SQL_CONDITIONS[rule.id]
    window = rule.condition.window_seconds * 1000 - 1
    return f"""SELECT * FROM (SELECT *, {number} AS rule_no, {group} AS group_key, {key} AS dk, {HUMAN} AS human,
        '{rule.id}' AS rule_id, '{rule.severity}' AS rule_severity, {rule.dedup_ttl_seconds * 1000} AS dedup_ms,
        {rule.throttle_seconds * 1000} AS throttle_ms,
        count(*) OVER (PARTITION BY {group} ORDER BY epoch_ms(event_ts) RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) AS c
        FROM ecs WHERE {where}) WHERE c >= {rule.condition.threshold}"""


def _walked(rules: list[tuple[int, object]], out: str) -> str:
    """Suppression of the rules' candidates, one row after another."""
    rows = " UNION ALL ".join(_candidates(r, i) for i, r in rules)
    kind = "STRUCT(k VARCHAR, e BIGINT)[]"
    dup = "len(list_filter(w.live, lambda x: x.k = o.dk AND x.e > o.t)) > 0"
    return f"""WITH RECURSIVE {ECS}, cand AS ({rows}),
        ordered AS (SELECT *, concat(cast(rule_no AS VARCHAR), '/', group_key) AS g, epoch_ms(event_ts) AS t,
            row_number() OVER (PARTITION BY rule_no, group_key ORDER BY event_ts, id) AS rn FROM cand),
        walk AS (SELECT g, rn, CAST([{{'k': dk, 'e': t + dedup_ms}}] AS {kind}) AS live, t + throttle_ms AS free_at,
                     'emitted' AS disposition FROM ordered WHERE rn = 1
                 UNION ALL SELECT o.g, o.rn,
                     CASE WHEN {dup} THEN w.live ELSE list_append(list_filter(w.live, lambda x: x.e > o.t), {{'k': o.dk, 'e': o.t + o.dedup_ms}}) END,
                     CASE WHEN {dup} OR w.free_at > o.t THEN w.free_at ELSE o.t + o.throttle_ms END,
                     CASE WHEN {dup} THEN 'deduplicated' WHEN w.free_at > o.t THEN 'throttled' ELSE 'emitted' END
                     FROM walk w JOIN ordered o ON o.g = w.g AND o.rn = w.rn + 1)
        {out}"""


ALL_RULES = list(enumerate(TUNED_RULES))


def _rule_check(number: int, rule) -> str:
    return _walked([(number, rule)], f"""SELECT rule_id, rule_severity AS severity, {SQL_TITLES[rule.id]} AS title,
        {_iso('event_ts')} AS created_at, cast(c AS INTEGER) AS event_count, source_ip AS meta_source_ip
        FROM walk JOIN ordered USING (g, rn) WHERE disposition = 'emitted'""")


def _ip_number(ip: str) -> str:
    return "(" + " + ".join(f"cast(split_part({ip}, '.', {i + 1}) AS BIGINT) * {m}"
                            for i, m in enumerate((16777216, 65536, 256, 1))) + ")"


FEED = f"""lines AS (SELECT {FEED_NAME} AS feed, s_suppkey AS line_no, {FEED_LINE.format(str='VARCHAR')} AS line FROM supplier),
    entries AS (SELECT feed, line_no, CASE WHEN regexp_full_match(entry, '[\\d.]+/\\d+') THEN 'cidr'
        WHEN regexp_full_match(entry, '[\\d.]+') THEN 'ip' END AS kind, entry
        FROM (SELECT *, trim(split_part(split_part(line, '#', 1), ';', 1)) AS entry FROM lines WHERE NOT regexp_matches(line, '^\\s*[#;]'))),
    exact AS (SELECT entry AS ip, min(feed) AS feed FROM entries WHERE kind = 'ip' GROUP BY 1),
    blocks AS (SELECT *, n - n % size AS lo, n - n % size + size - 1 AS hi FROM (
        SELECT feed, line_no, {_ip_number("split_part(entry, '/', 1)")} AS n,
            cast(pow(2, 32 - cast(split_part(entry, '/', 2) AS INTEGER)) AS BIGINT) AS size FROM entries WHERE kind = 'cidr')),
    inside AS (SELECT ip, arg_min(feed, (feed, line_no)) AS feed FROM
        (SELECT DISTINCT source_ip AS ip, {_ip_number('source_ip')} AS num FROM ecs) JOIN blocks ON num BETWEEN lo AND hi GROUP BY 1)"""
CONFIDENCE = """CASE feed WHEN 'feodo' THEN 'high' WHEN 'blocklist_de' THEN 'medium' WHEN 'spamhaus_drop' THEN 'high' END"""

CLIENT = """coalesce(CASE WHEN xff <> '' THEN trim(split_part(xff, ',', 1)) END, peer, 'unknown')"""
REQ = f"req AS ({duckdb_requests()})"
BROWSER = "CASE k % 6 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' WHEN 3 THEN 'Other' WHEN 5 THEN 'Edge' END"
SYSTEM = "CASE k % 6 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Linux' WHEN 3 THEN 'Other' WHEN 5 THEN 'Windows' END"

WANT = f"want AS ({duckdb_expected()})"


def _parse_check(name: str) -> str:
    fields = ", ".join(f"want_{f} AS {f}" for f in FIELDS)
    return f"""WITH {WANT} SELECT id, '{CONSTANTS[name][0]}' AS dataset, {_SECOND} AS ts,
        hostname, {fields} FROM want WHERE parser = '{name}' AND reason IS NULL"""


def _by_parser(index: int) -> str:
    return "CASE parser " + " ".join(f"WHEN '{p}' THEN '{c[index]}'" for p, c in CONSTANTS.items()) + " END"


GEO_SQL = """CASE WHEN source_ip LIKE '81.2.%' AND geo_no IN (SELECT n_nationkey FROM nation) THEN {} END"""
VENDOR = """CASE substr(replace(upper({}), ':', ''), 1, 6) WHEN 'B827EB' THEN 'Raspberry Pi Foundation'
    WHEN 'DCA632' THEN 'Raspberry Pi Foundation' WHEN '0418D6' THEN 'Ubiquiti Networks' END"""
WORDS = ", ".join(f"'{w}'" for w in SEARCH_WORDS.split())

CHECKS: dict[str, str] = {
    "top_source_ips": _over_ecs(f"""SELECT source_ip, count(*) AS event_count, coalesce(max(country_name), 'Unknown') AS country
        FROM ecs WHERE {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "pruned_dashboard": _over_ecs(f"""SELECT source_ip, count(*) AS event_count, coalesce(max(country_name), 'Unknown') AS country
        FROM ecs WHERE {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "dashboard_stats": _over_alerts(f"""SELECT count(*) AS total_events,
        (SELECT count(*) FROM alerts WHERE created_at >= TIMESTAMP '2024-01-01') AS total_alerts,
        count(*) FILTER (WHERE dataset = 'unifi.firewall' AND outcome = 'failure') AS blocked_connections,
        count(*) FILTER (WHERE category LIKE '%authentication%' AND outcome = 'failure') AS auth_failures,
        count(*) FILTER (WHERE dataset = 'unifi.vpn' AND type = 'start') AS active_vpn_sessions,
        count(*) FILTER (WHERE matched) AS threat_intel_matches FROM ecs WHERE {RANGE}"""),
    "firewall_activity": _histogram("hour", "dataset = 'unifi.firewall'", {
        "allowed": "count(*) FILTER (WHERE outcome = 'success')", "denied": "count(*) FILTER (WHERE outcome = 'failure')"}),
    "blocked_total": _over_ecs(f"SELECT count(*) AS blocked FROM ecs WHERE {RANGE} AND dataset = 'unifi.firewall' AND outcome = 'failure'"),
    "timeseries_bytes": _histogram("day", "true", {"events": "count(*)", "total": "sum(bytes)"}),
    "bandwidth_hourly": _histogram("hour", "true", {"bytes": "sum(bytes)"}),
    "failed_auth_hourly": _histogram("hour", "category LIKE '%authentication%' AND outcome = 'failure'", {"events": "count(*)"}),
    "events_per_minute": _over_ecs(f"SELECT {_iso('m')} AS minute, count(*) AS events FROM (SELECT date_trunc('minute', event_ts) AS m FROM ecs) GROUP BY m"),
    "geo_map": _over_ecs(f"""SELECT country_iso_code, max(country_name) AS country, max(lat) AS lat, max(lon) AS lon, count(*) AS count
        FROM ecs WHERE {RANGE} AND lat IS NOT NULL GROUP BY 1 ORDER BY count DESC, 1 LIMIT 200"""),
    "geo_map_scaled": _over_ecs(f"""SELECT *, round(count / (max(count) OVER ()), 6) AS scale FROM (
        SELECT country_iso_code, max(country_name) AS country, max(lat) AS lat, max(lon) AS lon, count(*) AS count
        FROM ecs WHERE {RANGE} AND lat IS NOT NULL GROUP BY 1 ORDER BY count DESC, 1 LIMIT 200)"""),
    "wireless_by_ssid": _over_ecs(f""", t AS (SELECT ssid, type, count(*) AS n FROM ecs WHERE {RANGE} AND dataset = 'unifi.wireless' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY ssid ORDER BY n DESC, type) AS k FROM t)
        SELECT ssid, cast(sum(n) AS BIGINT) AS event_count, string_agg(concat(type, ':', cast(n AS VARCHAR)), ',' ORDER BY type) FILTER (WHERE k <= 5) AS by_type
        FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "dataset_counts": _over_ecs("SELECT dataset, count(*) AS n FROM ecs GROUP BY 1"),
    "retention_tiers": _over_ecs("""SELECT CASE WHEN a >= 90 THEN 'delete' WHEN a >= 7 THEN 'warm' ELSE 'hot' END AS tier,
        count(DISTINCT d) AS days, count(*) AS events FROM (SELECT cast(event_ts AS DATE) AS d,
        date_diff('day', cast(event_ts AS DATE), DATE '2024-02-05') AS a FROM ecs) GROUP BY 1"""),
    "search_logs": _over_ecs(f"""SELECT {EVENT} FROM ecs WHERE {RANGE} AND severity >= 3
        AND list_has_any(string_split_regex(lower(message), '[^\\w]+'), ['click', '33']) ORDER BY event_ts DESC, id LIMIT 50 OFFSET 50"""),
    "full_text_search": f"""SELECT doc_id, lang, source FROM documents
        WHERE list_has_any(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), [{WORDS}])""",
    "store_round_trip": _over_ecs(f"SELECT {EVENT} FROM ecs"),
    "pruned_search": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE {RANGE}"),
    "pruned_search_to": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE event_ts <= TIMESTAMP '2024-01-31'"),
    "pruned_search_from": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE event_ts >= TIMESTAMP '2024-01-15 12:00:00'"),
    "get_event": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE id = '000000000123'"),
    "recent_vpn": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE {RANGE} AND dataset = 'unifi.vpn' ORDER BY event_ts DESC, id LIMIT 100"),
    "recent_threat_matches": _over_ecs(f"SELECT {EVENT} FROM ecs WHERE {RANGE} AND matched ORDER BY event_ts DESC, id LIMIT 50"),
    "list_alerts": _over_alerts(f"SELECT {FLAT} FROM alerts WHERE severity = 'medium' ORDER BY alerts.created_at DESC, id LIMIT 50"),
    "get_alert": _over_alerts(f"SELECT {FLAT} FROM alerts WHERE id = '{KNOWN_ALERT}'"),
    "acknowledge_alerts": _over_alerts(f"""SELECT id, ack_id IS NOT NULL AS acknowledged, CASE WHEN ack_id IS NOT NULL THEN 'bob' END AS acknowledged_by,
        {_iso('ack_at')} AS acknowledged_at FROM alerts LEFT JOIN acked ON id = ack_id"""),
    "unacknowledged_count": _over_alerts("SELECT count(*) AS open_alerts FROM alerts WHERE minute(created_at) >= 30"),
    "pred_eq": _over_ecs("SELECT id FROM ecs WHERE outcome = 'failure'"),
    "pred_ne": _over_ecs("SELECT id FROM ecs WHERE coalesce(user_name, '') <> 'user7'"),
    "pred_contains": _over_ecs("SELECT id FROM ecs WHERE contains(message, 'user 1')"),
    "pred_regex": _over_ecs("SELECT id FROM ecs WHERE regexp_matches(source_ip, '^10\\.0\\.\\d+\\.\\d+$')"),
    "pred_gt": _over_ecs("SELECT id FROM ecs WHERE bytes > 100"),
    "pred_gte": _over_ecs("SELECT id FROM ecs WHERE bytes >= 1073741824"),
    "pred_lt": _over_ecs("SELECT id FROM ecs WHERE severity < 4"),
    "pred_lte": _over_ecs("SELECT id FROM ecs WHERE severity <= 4"),
    "sliding_count": _over_ecs(f"""SELECT id, source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY epoch_ms(event_ts)
        RANGE BETWEEN {DAY * 1000 - 1} PRECEDING AND CURRENT ROW) AS n FROM ecs"""),
    "threshold_candidates": _over_ecs(f", c AS ({_candidates(TUNED_RULES[0], 0)}) SELECT id, group_key, c AS event_count FROM c"),
    "suppress_alerts": _walked(ALL_RULES, "SELECT rule_no, id, group_key, disposition FROM walk JOIN ordered USING (g, rn)"),
    "alerts_by_rule": _walked(ALL_RULES, """SELECT rule_id, rule_severity AS severity, disposition, count(*) AS n
        FROM walk JOIN ordered USING (g, rn) GROUP BY 1, 2, 3"""),
    "rules_mixed_windows": _walked(list(enumerate(MIXED_RULES)), """SELECT rule_id, rule_severity AS severity, disposition, count(*) AS n
        FROM walk JOIN ordered USING (g, rn) GROUP BY 1, 2, 3"""),
    **{f"rule_{r.id}": _rule_check(i, r) for i, r in ALL_RULES},
    "brute_force": _brute(DAY, 3),
    "port_scan": _scan(DAY, 3),
    "port_scan_no_reset": _over_ecs(f"""SELECT source_ip, epoch_ms(event_ts) // {DAY * 1000} AS bucket, count(DISTINCT dest_port) AS ports
        FROM ecs GROUP BY 1, 2 HAVING count(DISTINCT dest_port) >= 3"""),
    "lateral_movement": _lateral(DAY, 3),
    "rogue_device": _over_ecs(f"SELECT {FLAT} FROM ({_rogue('uid % 2 = 1')})"),
    "vpn_geo_anomaly": _over_ecs(f", {FIRSTS} SELECT {FLAT} FROM ({VPN})"),
    "admin_off_hours": _over_ecs(f"SELECT {FLAT} FROM ({ADMIN})"),
    "correlate_all": _over_ecs(f""", {FIRSTS}, fast AS ({_brute(300, 10)}), scans AS ({_scan(60, 15)}), moves AS ({_lateral(60, 10)}),
        slow AS (SELECT rule_id, title, {_iso('created_at')} AS created_at, event_count FROM ({ADMIN} UNION ALL {_rogue()} UNION ALL {VPN}))
        SELECT * FROM slow UNION ALL SELECT 'brute_force', title, created_at, event_count FROM fast
        UNION ALL SELECT 'port_scan', title, created_at, event_count FROM scans
        UNION ALL SELECT 'lateral_movement', concat('Lateral Movement: ', source_ip), created_at, event_count FROM moves"""),
    "enrich_geo": _over_ecs(f"""SELECT id, {GEO_SQL.format("concat('C', cast(geo_no AS VARCHAR))")} AS country_iso_code,
        {GEO_SQL.format("concat('NATION_', cast(geo_no AS VARCHAR))")} AS country_name, {GEO_SQL.format('lat')} AS lat,
        {GEO_SQL.format('lon')} AS lon FROM ecs"""),
    "threat_exact": _over_ecs(f", {FEED} SELECT id, x.ip IS NOT NULL AS matched, x.feed, CASE WHEN x.ip IS NOT NULL THEN 90 ELSE 0 END AS score FROM ecs LEFT JOIN exact x ON source_ip = x.ip"),
    "threat_cidr": _over_ecs(f", {FEED} SELECT id, x.ip IS NOT NULL AS matched, x.feed, CASE WHEN x.ip IS NOT NULL THEN 85 ELSE 0 END AS score FROM ecs LEFT JOIN inside x ON source_ip = x.ip"),
    "enrich_threat": _over_ecs(f""", {FEED}, m AS (SELECT id, coalesce(x.feed, y.feed) AS feed,
        CASE WHEN x.ip IS NOT NULL THEN 90 WHEN y.ip IS NOT NULL THEN 85 ELSE 0 END AS score
        FROM ecs LEFT JOIN exact x ON source_ip = x.ip LEFT JOIN inside y ON source_ip = y.ip)
        SELECT id, score > 0 AS matched, feed, score, {CONFIDENCE} AS confidence FROM m"""),
    "mac_vendor": _over_ecs(f"SELECT id, mac, {VENDOR.format('mac')} AS mac_vendor FROM ecs"),
    "ip_functions": _over_ecs(f"""SELECT DISTINCT source_ip AS ip, dest_ip AS dest, {_ip_number('source_ip')} AS number, dest_ip AS back,
        source_ip LIKE '10.%' AS private, source_ip LIKE '10.%' AS unrouted FROM ecs"""),
    "user_agent": f"""WITH {REQ} SELECT id, {BROWSER} AS browser, {SYSTEM} AS os,
        k % 6 = 3 AS is_bot, k % 6 = 1 AS is_mobile, k % 6 IN (0, 2, 5) AS is_pc FROM req WHERE k % 6 <> 4""",
    "user_agent_rollup": f"""WITH {REQ} SELECT {BROWSER} AS browser, {SYSTEM} AS os, k % 6 = 3 AS is_bot, k % 6 = 1 AS is_mobile,
        count(*) AS requests FROM req WHERE k % 6 <> 4 GROUP BY 1, 2, 3, 4""",
    "audit_log": f"""WITH {REQ} SELECT id, concat('user', cast(uid AS VARCHAR)) AS user_id, concat(CASE method WHEN 'POST' THEN 'create'
        WHEN 'PUT' THEN 'update' ELSE 'delete' END, ':', CASE WHEN path = '/' THEN 'unknown' WHEN path = '/health' THEN 'health'
        ELSE cast(k AS VARCHAR) END) AS action, method, path, status AS status_code, {CLIENT} AS ip_address, user_agent,
        {_iso('event_ts')} AS created_at FROM req WHERE method <> 'GET'""",
    "rate_limit": f"""WITH {REQ} SELECT id, client_ip, bucket, retry_after FROM (SELECT *, row_number() OVER (PARTITION BY client_ip, bucket ORDER BY event_ts, id) AS rn
        FROM (SELECT *, {CLIENT} AS client_ip, s - s % {DAY} AS bucket, {DAY} - s % {DAY} AS retry_after
        FROM (SELECT *, epoch_ms(event_ts) // 1000 AS s FROM req WHERE path LIKE '/api/%'))) WHERE rn > 2""",
    "parse_header": f"WITH {ECS} SELECT id, {_SECOND} AS ts, hostname AS host FROM ecs",
    "classify": f"WITH {WANT} SELECT coalesce(parser, 'none') AS parser, count(*) AS n FROM want GROUP BY 1",
    **{f"parse_{name}": _parse_check(name) for name in CONSTANTS},
    "dead_letters": f"WITH {WANT} SELECT id, reason FROM want WHERE reason IS NOT NULL",
    "pipeline_counts": f"""WITH {WANT} SELECT CASE WHEN parser IS NULL THEN 'unrecognized' ELSE concat('unifi.', parser) END AS dataset,
        CASE reason WHEN 'parse_failed' THEN 'failed' WHEN 'no_parser' THEN 'dead_letter' ELSE 'success' END AS status, count(*) AS n FROM want GROUP BY 1, 2""",
    "to_ecs": f"""WITH {WANT} SELECT id, {_by_parser(1)} AS kind, want_category AS category, want_type AS type, {_by_parser(3)} AS observer,
        'Ubiquiti' AS vendor, 0 AS score FROM want WHERE reason IS NULL""",
    "ingest": f"""WITH {WANT}, ecs AS (SELECT *, want_source_ip AS raw_ip FROM want WHERE reason IS NULL),
        {FEED.replace("SELECT DISTINCT source_ip AS ip", "SELECT DISTINCT want_source_ip AS ip").replace(_ip_number('source_ip'), _ip_number('want_source_ip')).replace("FROM ecs)", "FROM ecs WHERE want_source_ip IS NOT NULL)")}
        SELECT concat('unifi.', parser) AS dataset, count(*) AS n,
        count(*) FILTER (WHERE want_source_ip LIKE '81.2.%' AND cast(split_part(want_source_ip, '.', 3) AS INTEGER) IN (SELECT n_nationkey FROM nation)) AS located,
        count(*) FILTER (WHERE x.ip IS NOT NULL OR y.ip IS NOT NULL) AS threats, count({VENDOR.format('want_source_mac')}) AS vendors
        FROM ecs LEFT JOIN exact x ON want_source_ip = x.ip LEFT JOIN inside y ON want_source_ip = y.ip GROUP BY 1""",
    "render_template": _over_ecs(f"""SELECT id, concat(dataset, ': ', coalesce(user_name, ''), ' at ', source_ip, ' sent ', {HUMAN},
        ' ({{no.such}}) unknown') AS text FROM ecs"""),
    "formats": _over_ecs(f"""SELECT id, {HUMAN} AS size, CASE severity % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS level,
        CASE severity % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' WHEN 4 THEN 'Info' ELSE 'Odd' END AS shown,
        strftime(event_ts, 'siem-logs-%Y.%m.%d') AS index_name FROM ecs"""),
    "feed_parse": f"WITH {ECS}, {FEED} SELECT feed, line_no, kind, entry FROM entries WHERE kind IS NOT NULL",
    "url_hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages",
    "event_round_trip": _over_ecs(f"SELECT {EVENT} FROM ecs"),
    "alert_envelope": _over_alerts(f"SELECT id, 'alert' AS type, id AS data_id, {_iso('created_at')} AS created_at, source_ip FROM alerts"),
    "alert_payload": _over_alerts("SELECT id, rule_id, title FROM alerts"),
    "notifications": _over_alerts("""SELECT id, concat('[', upper(severity), '] Security Alert: ', title) AS subject,
        'alert_generic.html' AS template, source_ip FROM alerts"""),
    "enrich_geo_six": _over_ecs(f"""SELECT id, {SIX_IP.format(str='VARCHAR')} AS ip, CASE WHEN public THEN concat('C', geo_no) END AS country_iso_code,
        CASE WHEN public THEN (SELECT n_name FROM nation WHERE n_nationkey = geo_no) END AS country_name,
        CASE WHEN public AND geo_no IN (SELECT n_nationkey FROM nation) THEN geo_no * 3.0::DOUBLE - 36 END AS lat FROM ecs"""),
    "threat_dense": _over_ecs("SELECT id, true AS matched, 'own' AS feed, 85 AS score FROM ecs"),
    "notify_dedup_hourly": _over_alerts(f"""SELECT {FLAT} FROM (
        SELECT * REPLACE (created_at + to_minutes(later) AS created_at) FROM alerts, (VALUES (0), (60), (130)) v(later))"""),
    "notify_dedup": _over_alerts(f"SELECT {FLAT} FROM alerts"),
}
# The two lookups that do not broadcast give the same rows.
CHECKS["enrich_geo_six_large"] = CHECKS["enrich_geo_six"]
CHECKS["enrich_geo_large"] = CHECKS["enrich_geo"]
CHECKS["threat_cidr_large"] = CHECKS["threat_cidr"]
