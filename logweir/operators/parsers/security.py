"""Intrusion detection, threat management and firewall log types."""
from __future__ import annotations

from .base import Derived, Parser, Pattern, choose, extract, first_group, like, lower, one_of, strip, text

# Signature priority to severity; anything else is 5.
PRIORITY_SEVERITY = {1: 9, 2: 7, 3: 5, 4: 3}

# Intrusion patterns.
IDS_KEYWORDS = (r"(?i)\[\*\*\].*\[\*\*\]|\[Classification:|\[Priority:\s*\d\]"
                r"|\"event_type\":\s*\"alert\"|IDS Alert:|IPS Alert:")
EVE_HINT = r'"event_type"\s*:\s*"alert"'
FAST_HEADER = r"\[\*\*\]\s+\[(\d+):(\d+):(\d+)\]\s+(.+?)\s+\[\*\*\]"
FAST_CLASS = r"\[Classification:\s+([^\]]+)\]"
FAST_PRIORITY = r"\[Priority:\s+(\d+)\]"
FAST_HOSTS = r"\{(\w+)\}\s+([\d.]+)(?::(\d+))?\s+->\s+([\d.]+)(?::(\d+))?"
IDS_LINE = r"(?i)(?:IDS Alert|IPS Alert|ALERT)[:\s]+([^;]+?);\s*SRC:([\d.]+).*?DST:([\d.]+)"

# Threat patterns.
THREAT_KEYWORDS = (r"(?i)ubnt-threat-management|threat=|malware detected|\[IPS\]"
                   r"|DPI:.*BLOCK|honeypot.*triggered|Blocked.*threat")
THREAT_MANAGEMENT = (r"(?i)(?:ubnt-threat-management|threat-management).*?(BLOCK|ALLOW|DROP|ALERT)\s+"
                     r"(?:.*?src=([\d.]+))?(?:.*?dst=([\d.]+))?(?:.*?threat=(\S+))?(?:.*?url=(\S+))?")
IPS_SIMPLE = r"(?i)\[IPS\]\s+(Blocked|Detected|Allowed)\s+([\d.]+)\s+-\s+(.+?)(?:\s*$)"
MALWARE = r"(?i)malware\s+detected[:\s]+(\S+).*?from\s+([\d.]+)"
DPI = r"(?i)DPI:\s*(BLOCKED|ALLOWED)\s+(\S+).*?src=([\d.]+).*?dst=([\d.]+)"
HONEYPOT = r"(?i)(?:honeypot|canary).*?(?:triggered|hit).*?(?:from\s+([\d.]+))?"
BLOCKED_FROM = r"(?i)(?:Blocked|Dropped)\s+(\S+).*?(?:from|at)\s+([\d.]+)"

# Firewall patterns, key=value fields and interface prefixes.
FIREWALL_KEYWORDS = (r"(?i)\[UFW\s+(?:BLOCK|ALLOW|LIMIT|FORWARD)\]|\[ACL-|\[WAN_LOCAL|\[WAN-LOCAL|\[LAN_LOCAL"
                     r"|\[FORWARD|kernel:.*?SRC=[\d.]|\[BLOCK\]|\[DROP\]|\[ACCEPT\]")
UFW = (r"(?i)\[UFW\s+(BLOCK|ALLOW|LIMIT|FORWARD)\](?:.*?IN=(\S*))?(?:.*?OUT=(\S*))?(?:.*?MAC=([\da-f:]+))?"
       r"(?:.*?SRC=([\d.]+))?(?:.*?DST=([\d.]+))?(?:.*?PROTO=(\S+))?(?:.*?SPT=(\d+))?(?:.*?DPT=(\d+))?(?:.*?LEN=(\d+))?")
ACL_NAME = r"(?i)\[([A-Z]{2,10}-[A-Z]{2,10}-[A-Z]{2,10}-([DA])(?:-\d+)?)\]"
ACL_HEADER = r"(?i)\[([A-Z0-9_\-]+-([DA])-\d*)\]"
KERNEL_VERDICT = r"(?i)kernel:.*?\[(BLOCK|DROP|ACCEPT|FORWARD)\]"
ANY_SOURCE = r"SRC=[\d.]+"
KV = {"in_if": r"IN=(\S*)", "out_if": r"OUT=(\S*)", "mac": r"MAC=([\da-fA-F:]+)", "src": r"SRC=([\d.]+)",
      "dst": r"DST=([\d.]+)", "proto": r"PROTO=(\S+)", "spt": r"SPT=(\d+)", "dpt": r"DPT=(\d+)", "len": r"LEN=(\d+)"}
WAN_INTERFACES = r"^(eth0|eth1|ppp|wan)"
LAN_INTERFACES = r"^(br|eth2|eth3|eth4|lan|vlan)"


JSON_BODY = "substring(raw, instr(raw, '{'))"


def _severity_of(name: str) -> Derived:
    levels = " ".join(f"WHEN {p} THEN '{s}'" for p, s in PRIORITY_SEVERITY.items())
    return lambda get: f"CASE try_cast({get(name)} AS int) {levels} ELSE '5' END"


def _json(path: str, default: str = "") -> Derived:
    return lambda get: f"coalesce(get_json_object({JSON_BODY}, {text(path)}), {text(default)})"


IDS = Parser(
    name="ids_ips", dataset="unifi.ids_ips", kind="alert", category="intrusion_detection", severity=5,
    observer="ids", tags="ids ips alert", claim="any", keep_zero_port=True,
    programs=("snort", "suricata", "barnyard2", "unified2", "alert_fast"), keywords=IDS_KEYWORDS,
    defaults={"outcome": "failure", "type": "denied"},
    patterns=(
        Pattern(
            EVE_HINT, also=f"try_parse_json({JSON_BODY}) IS NOT NULL", message="Suricata alert: {name}", severity="{severity}",
            derive={
                "name": _json("$.alert.signature", "unknown"), "sid": _json("$.alert.signature_id"),
                "cls": _json("$.alert.category", "unknown"), "pri": _json("$.alert.severity", "3"),
                "src": _json("$.src_ip"), "dst": _json("$.dest_ip"), "spt": _json("$.src_port"),
                "dpt": _json("$.dest_port"),
                "proto": lambda get: f"lower({_json('$.proto')(get)})",
                "severity": _severity_of("pri"),
            },
            fields={"source_ip": "{src}", "source_port": "{spt}", "dest_ip": "{dst}", "dest_port": "{dpt}",
                    "protocol": "{proto}"},
            labels={"signature_name": "{name}", "classification": "{cls}", "priority": "{pri}",
                    "signature_id?": "{sid}"}),
        Pattern(EVE_HINT, reject=True),
        Pattern(
            FAST_HEADER, "gid sid rev title", severity="{severity}",
            message="IDS/IPS alert [{gid}:{sid}:{rev}]: {name} (Priority {pri})",
            derive={
                "name": strip("title"),
                "cls": lambda get: f"trim({extract(FAST_CLASS, 1)})",
                "pri": lambda get: f"coalesce(cast(try_cast({extract(FAST_PRIORITY, 1)} AS int) AS string), '3')",
                "severity": _severity_of("pri"),
                "proto": lambda get: f"lower({extract(FAST_HOSTS, 1)})",
                "src": first_group(FAST_HOSTS, 2), "spt": first_group(FAST_HOSTS, 3),
                "dst": first_group(FAST_HOSTS, 4), "dpt": first_group(FAST_HOSTS, 5),
            },
            fields={"source_ip": "{src}", "source_port": "{spt}", "dest_ip": "{dst}", "dest_port": "{dpt}",
                    "protocol": "{proto}"},
            labels={"signature_name": "{name}", "classification": "{cls|unknown}", "priority": "{pri}",
                    "signature_id?": "{gid}:{sid}:{rev}"}),
        Pattern(
            IDS_LINE, "title src dst", message="IDS alert: {name}", derive={"name": strip("title")},
            fields={"source_ip": "{src}", "dest_ip": "{dst}"},
            labels={"signature_name": "{name}", "classification": "unknown", "priority": "3"}),
    ))

_VERDICT = {"outcome": "{outcome}", "type": "{type}"}


def _verdict(test):
    return {"outcome": choose(test, "failure", "unknown"), "type": choose(test, "denied", "info")}


_BLOCKED = {"outcome": "failure", "type": "denied"}

THREAT = Parser(
    name="threat", dataset="unifi.threat", kind="alert", category="intrusion_detection", severity=8,
    observer="ids", tags="threat ips", claim="any", keywords=THREAT_KEYWORDS,
    programs=("ubnt-threat-management", "threat-management", "ubnt-ips", "suricata", "snort", "honeypot",
              "malware-detect"),
    patterns=(
        Pattern(
            THREAT_MANAGEMENT, "action src dst threat url",
            message="Threat {verb}: {threat|unknown} from {src|?} to {dst|?}",
            derive={"verb": choose(one_of("action", "block", "drop"), "blocked", "detected"),
                    **_verdict(one_of("action", "block", "drop"))},
            fields={"source_ip": "{src}", "dest_ip": "{dst}", **_VERDICT},
            labels={"threat_name": "{threat|unknown}", "url": "{url}"}),
        Pattern(
            IPS_SIMPLE, "action ip threat", message="IPS {verb}: {threat} from {ip}",
            derive={"verb": lower("action"), **_verdict(one_of("action", "blocked"))},
            fields={"source_ip": "{ip}", **_VERDICT}, labels={"threat_name": "{threat}"}),
        Pattern(
            MALWARE, "threat ip", message="Malware detected: {threat} from {ip}", severity=9,
            fields={"source_ip": "{ip}", **_BLOCKED}, labels={"threat_name": "{threat}"}),
        Pattern(
            DPI, "action cat src dst", message="DPI {verb}: {cat} from {src}",
            derive={"verb": lower("action"), **_verdict(one_of("action", "blocked"))},
            fields={"source_ip": "{src}", "dest_ip": "{dst}", **_VERDICT},
            labels={"threat_name": "{cat}", "dpi_category": "{cat}"}),
        Pattern(
            HONEYPOT, "ip", message="Honeypot triggered from {ip|unknown}", severity=9,
            fields={"source_ip": "{ip}", "outcome": "unknown", "type": "info"},
            labels={"threat_name": "honeypot_trigger"}),
        Pattern(
            BLOCKED_FROM, "threat ip", message="Threat blocked: {threat} from {ip}",
            fields={"source_ip": "{ip}", **_BLOCKED}, labels={"threat_name": "{threat}"}),
    ))


def _either(group: str, key: str) -> Derived:
    """The pattern's own group if it took part, else the first key=value pair in the line."""
    pair = extract(KV[key], 1)
    return lambda get: f"coalesce(nullif({get(group)}, ''), {pair})" if group else pair


def direction(in_if: str, out_if: str) -> str:
    """SQL: inbound / outbound / internal / unknown from two interface names."""
    def wan(x):
        return like(WAN_INTERFACES, f"lower({x})")

    def lan(x):
        return like(LAN_INTERFACES, f"lower({x})")

    return (f"CASE WHEN {in_if} != '' AND {out_if} != '' THEN "
            f"CASE WHEN {wan(in_if)} AND {lan(out_if)} THEN 'inbound' "
            f"WHEN {lan(in_if)} AND {wan(out_if)} THEN 'outbound' "
            f"WHEN {lan(in_if)} AND {lan(out_if)} THEN 'internal' ELSE 'unknown' END "
            f"WHEN {wan(in_if)} THEN 'inbound' WHEN {wan(out_if)} THEN 'outbound' ELSE 'unknown' END")


def _firewall(regex: str, groups: str, blocked: Derived, own: bool = False) -> Pattern:
    def part(key):
        return _either(key + "_g" if own else "", key)

    def number(key):
        return lambda get: f"coalesce(cast(nullif(try_cast({part(key)(get)} AS int), 0) AS string), '')"

    return Pattern(
        regex, groups,
        message="Firewall {verb} {proto|traffic} {src|?}:{spt|?} -> {dst|?}:{dpt|?}",
        derive={
            "verb": choose(blocked, "blocked", "allowed"),
            "type": choose(blocked, "denied", "allowed"),
            "outcome": choose(blocked, "failure", "success"),
            "severity": choose(blocked, "7", "3"),
            "mac": part("mac"), "src": part("src"), "dst": part("dst"), "len": part("len"),
            "proto": lambda get: f"lower({part('proto')(get)})",
            "spt": number("spt"), "dpt": number("dpt"),
            "direction": lambda get: direction(part("in_if")(get), part("out_if")(get)),
            "packets": lambda get: f"CASE WHEN try_cast({get('len')} AS bigint) > 0 THEN '1' ELSE '0' END",
        },
        severity="{severity}",
        fields={"source_ip": "{src}", "source_port": "{spt}", "source_mac": "{mac}", "dest_ip": "{dst}",
                "dest_port": "{dpt}", "protocol": "{proto}", "direction": "{direction}", "bytes": "{len}",
                "packets": "{packets}", "outcome": "{outcome}", "type": "{type}"})


FIREWALL = Parser(
    name="firewall", dataset="unifi.firewall", category="network", tags="firewall", claim="any",
    programs=("kernel", "ufw", "iptables", "ip6tables", "nftables"), keywords=FIREWALL_KEYWORDS,
    patterns=(
        _firewall(UFW, "action in_if_g out_if_g mac_g src_g dst_g proto_g spt_g dpt_g len_g",
                  one_of("action", "block"), own=True),
        _firewall(ACL_NAME, "acl mark", one_of("mark", "d")),
        _firewall(ACL_HEADER, "acl mark", one_of("mark", "d")),
        _firewall(ANY_SOURCE, "", lambda get: f"lower({extract(KERNEL_VERDICT, 1)}) != 'accept'"),
    ))
