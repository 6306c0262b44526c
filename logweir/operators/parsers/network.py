"""Wireless, DHCP, DNS, traffic, WAN and switch port log types."""
from __future__ import annotations

from .base import Parser, Pattern, choose, cut, extract, first_group, lower, one_of, phrase, strip, upper

# Wireless patterns.
WIRELESS_KEYWORDS = (r"(?i)IEEE\s+802\.11:\s+(?:auth|assoc|disassoc|deauth)|STA\s+[\da-f:]{17}\s+IEEE"
                     r"|WPA:\s+pairwise key|RADIUS\s+authentication")
WIFI_AUTH = r"(?i)(\S+):\s+STA\s+([\da-f:]{17})\s+IEEE\s+802\.11:\s+authenticated"
WIFI_ASSOC = r"(?i)(\S+):\s+STA\s+([\da-f:]{17})\s+IEEE\s+802\.11:\s+associated(?:\s+\(aid\s+(\d+)\))?"
WIFI_DISASSOC = r"(?i)(\S+):\s+STA\s+([\da-f:]{17})\s+IEEE\s+802\.11:\s+disassociated"
WIFI_DEAUTH = (r"(?i)(\S+):\s+STA\s+([\da-f:]{17})\s+IEEE\s+802\.11:\s+deauthenticated"
               r"(?:\s+due to\s+([^\(]+))?(?:\s*\(idle for\s+(\d+)\s+seconds\))?")
WIFI_WPA = r"(?i)(\S+):\s+STA\s+([\da-f:]{17})\s+WPA:\s+(.+)"
WIFI_RADIUS = r"(?i)STA\s+([\da-f:]{17}):\s+RADIUS\s+authentication\s+(failed|succeeded)"
WIFI_ROAM = r"(?i)(?:FT|Roaming|roamed).*?STA\s+([\da-f:]{17}).*?from\s+(\S+).*?to\s+(\S+)"
WIFI_REASON = r"(?i)reason=(\d+)"
WIFI_SIGNAL = r"(?i)signal=(-?\d+)\s*dBm"
WIFI_BSSID = r"(?i)BSSID[=:\s]+([\da-f:]{17})"
WIFI_SSID = r"(?i)SSID[=:\s]+['\"]?([^'\"]+)['\"]?"

# DHCP patterns.
DHCP_KEYWORDS = r"(?i)DHCPACK|DHCPREQUEST|DHCPOFFER|DHCPDISCOVER|DHCPNAK|DHCPRELEASE"
DHCP_ACK = r"(?i)DHCPACK\(([^)]+)\)\s+([\d.]+)\s+([\da-f:]+)(?:\s+(\S+))?"
DHCP_ACK_ISC = r"(?i)DHCPACK on ([\d.]+) to ([\da-f:]+)(?:\s+\(([^)]+)\))? via (\S+)"
DHCP_REQUEST = r"(?i)DHCPREQUEST\(([^)]+)\)\s+([\d.]+)\s+([\da-f:]+)(?:\s+(\S+))?"
DHCP_REQUEST_ISC = r"(?i)DHCPREQUEST for ([\d.]+) from ([\da-f:]+)(?:\s+\(([^)]+)\))? via (\S+)"
DHCP_OFFER = r"(?i)DHCPOFFER\(([^)]+)\)\s+([\d.]+)\s+([\da-f:]+)"
DHCP_DISCOVER = r"(?i)DHCPDISCOVER\(([^)]+)\)\s+([\da-f:]+)(?:\s+(\S+))?"
DHCP_NAK = r"(?i)DHCPNAK\(([^)]+)\)\s+([\d.]+)\s+([\da-f:]+)"
DHCP_RELEASE = r"(?i)DHCPRELEASE\(([^)]+)\)\s+([\d.]+)\s+([\da-f:]+)(?:\s+(\S+))?"
DHCP_RELEASE_ISC = r"(?i)DHCPRELEASE of ([\d.]+) from ([\da-f:]+)(?:\s+\(([^)]+)\))? via (\S+)"

# DNS patterns.
DNS_KEYWORDS = (r"(?i)query\[(?:A|AAAA|PTR|MX|TXT|SRV|CNAME|NS|SOA|ANY)\]|forwarded .+ to [\d.]|cached .+ is "
                r"|reply .+ is |NXDOMAIN|dnsmasq.*query")
DNS_BLOCKED = r"(?i)(?:blocked|blacklisted)\s+(\S+)\s+(?:from\s+([\d.]+))?"
DNS_NXDOMAIN = r"(?i)(?:reply|config)\s+(\S+)\s+is\s+NXDOMAIN"
DNS_QUERY = r"(?i)query\[([A-Z0-9]+)\]\s+(\S+)\s+from\s+([\d.]+)"
DNS_FORWARD = r"(?i)forwarded\s+(\S+)\s+to\s+([\d.]+)"
DNS_CACHED = r"(?i)cached\s+(\S+)\s+is\s+(\S+)"
DNS_REPLY = r"(?i)reply\s+(\S+)\s+is\s+(\S+)"

# Traffic patterns and connection states.
TRAFFIC_KEYWORDS = (r"(?i)\b(?:NEW|ESTABLISHED|RELATED|DESTROYED|INVALID)\b.*?(?:src=[\d.]|dst=[\d.])"
                    r"|ubnt-traffic|netflow|bytes=\d+.*pkts=\d+|\[UPDATE\]\s+(?:tcp|udp|icmp)")
CONNTRACK_BRACKET = (r"(?i)\[([A-Z]+)\]\s+(\w+)\s+\d+\s+\d+\s+(\S+)\s+src=([\d.]+)\s+dst=([\d.]+)\s+sport=(\d+)"
                     r"\s+dport=(\d+).*?(?:bytes=(\d+))?.*?(?:packets=(\d+))?")
CONNTRACK = (r"(?i)(NEW|ESTABLISHED|RELATED|DESTROYED|INVALID)\s+(?:.*?src=([\d.]+))?(?:.*?dst=([\d.]+))?"
             r"(?:.*?sport=(\d+))?(?:.*?dport=(\d+))?(?:.*?proto=(\w+))?(?:.*?bytes=(\d+))?(?:.*?packets=(\d+))?")
TRAFFIC_STAT = (r"(?i)(?:ubnt-traffic|traffic-stat|flow).*?(?:src=([\d.]+))?(?:.*?dst=([\d.]+))?"
                r"(?:.*?bytes=(\d+))?(?:.*?pkts=(\d+))?(?:.*?dur(?:ation)?=(\d+))?(?:.*?proto=(\w+))?")
NETFLOW = (r"([\d.]+):(\d+)\s+->\s+([\d.]+):(\d+)(?:\s+\[?(\w+)\]?)?(?:\s+(\d+)\s+bytes)?"
           r"(?:\s+(\d+)\s+(?:pkts|packets))?")
STATE_TYPE = {"NEW": "start", "ESTABLISHED": "info", "RELATED": "info", "DESTROYED": "end", "INVALID": "denied"}

# WAN patterns.
WAN_KEYWORDS = (r"(?i)Connect:\s+ppp\d+|LCP terminated|Modem hangup|PPPoE|bound to [\d.]+\s+--\s+renewal"
                r"|DHCPACK of [\d.]+ from|No DHCPOFFERS received|(?:eth\d|ppp\d|wan).*Link is (?:Up|Down)"
                r"|WAN failover|WAN fail-over|local IP address [\d.]+")
PPPOE_CONNECT = r"(?i)(?:Connect|Connected):\s+(ppp\d+)\s+<-->"
PPPOE_IP = r"(?i)local\s+IP\s+address\s+([\d.]+).*?remote\s+IP\s+address\s+([\d.]+)"
PPPOE_DOWN = r"(?i)(?:Modem hangup|LCP terminated|Connection terminated|pppd.*down|LCP: timeout)"
PPP_OK = r"(?i)(?:PAP|CHAP)\s+authentication\s+succeeded"
PPP_FAIL = r"(?i)(?:PAP|CHAP)\s+authentication\s+failed"
WAN_BOUND = r"(?i)bound to\s+([\d.]+)\s+--\s+(?:renewal|rebind)(?:\s+in\s+(\d+)\s+seconds)?"
WAN_ACK = r"(?i)DHCPACK of\s+([\d.]+) from\s+([\d.]+)"
WAN_NO_OFFER = r"(?i)No\s+DHCPOFFERS\s+received"
WAN_LINK = r"(eth\d+|ppp\d+|wan\d*):\s+Link\s+(?:is\s+)?([Uu]p|[Dd]own)(?:\s+(\d+\w+))?"
WAN_FAILOVER = r"(?i)WAN\s+(?:failover|fail-over|failback).*?(?:to\s+(\S+))?"
WAN_GATEWAY = r"(?i)(?:default\s+)?gateway(?:\s+changed)?\s+(?:to\s+)?([\d.]+)"

# Switch port patterns.
PORT_KEYWORDS = (r"(?i)swconfig.*port\s+\d+\s+link|port\s+\d+\s+on\s+\S+\s+entering\s+\w+\s+state"
                 r"|topology change\s+(?:detected|sent)|BPDU\s+guard\s+(?:triggered|activated)"
                 r"|VLAN\s+\d+\s+(?:added|removed|changed)|security violation|MAC\s+flap"
                 r"|PoE.*port.*(?:powered|overload)")
MAC_FLAP = r"(?i)MAC\s+([\da-f:]{17})\s+(?:moved|flapped|flapping)\s+from\s+(\S+)\s+to\s+(\S+)"
VIOLATION = (r"(?i)(?:security\s+violation|MAC\s+flap(?:ping)?|unauthorized\s+MAC)"
             r".*?(?:port\s+(\S+))?(?:.*?MAC\s+([\da-f:]{17}))?")
BPDU = r"(?i)BPDU\s+(?:guard|Guard)\s+(?:triggered|activated).*?(?:port\s+(\S+))?"
TOPOLOGY = r"(?i)topology change\s+(?:detected|sent|received)?.*?(?:on\s+(\S+))?"
STP_STATE = r"(?i)port\s+(\d+)\s+on\s+(\S+)\s+entering\s+(\w+)\s+state"
SWITCH_LINK = (r"(?i)(?:swconfig|switch).*?port\s+(\d+)\s+link\s+(up|down)"
               r"(?:.*?speed=(\w+))?(?:.*?duplex=(\w+))?")
PORT_LINK = r"(?i)(?:Port|port)\s+(\S+)\s+(?:link\s+)?((?:came\s+)?(?:up|down|connected|disconnected))"
VLAN = r"(?i)(?:VLAN|vlan)\s+(\d+)\s+(added|removed|changed|created|deleted)(?:.*?(?:on\s+(?:port\s+)?(\S+)))?"
POE = r"(?i)PoE.*?port\s+(\S+).*?(powered|off|overload|fault)"


def _wifi(regex, groups, action, message, kind, outcome="success", severity=None, labels=None, common="", **more):
    derive = dict(more.pop("derive", {}))
    extra = {"wifi_action": action}
    if "iface" in groups.split():
        extra["interface?"] = "{iface}"
    if common == "join":
        derive.update(bssid=first_group(WIFI_BSSID), signal=first_group(WIFI_SIGNAL),
                      ssid=lambda get: f"left(trim({extract(WIFI_SSID, 1)}), 64)")
        extra.update({"bssid?": "{bssid}", "ssid?": "{ssid}", "signal_dbm?": "{signal}"})
    if common == "leave":
        derive.update(reason=first_group(WIFI_REASON))
        extra["reason_code?"] = "{reason}"
    return Pattern(regex, groups, message=message, severity=severity, derive=derive,
                   fields={"source_mac": "{mac}", "type": kind, "outcome": outcome},
                   labels={**extra, **(labels or {})}, **more)


WIRELESS = Parser(
    name="wireless", dataset="unifi.wireless", category="session", severity=2, tags="wireless wifi",
    keywords=WIRELESS_KEYWORDS,
    patterns=(
        _wifi(WIFI_AUTH, "iface mac", "authenticated", "Wireless STA {mac} authenticated on {iface}", "start",
              common="join"),
        _wifi(WIFI_ASSOC, "iface mac aid", "associated", "Wireless STA {mac} associated on {iface}", "start",
              common="join"),
        _wifi(WIFI_DISASSOC, "iface mac", "disassociated", "Wireless STA {mac} disassociated from {iface}", "end",
              common="leave"),
        _wifi(WIFI_DEAUTH, "iface mac why idle", "deauthenticated",
              "Wireless STA {mac} deauthenticated from {iface}{because}", "end", common="leave",
              derive={"why_text": strip("why"), "because": phrase("why_text", ": ")}),
        _wifi(WIFI_WPA, "iface mac event", "wpa_handshake", "WPA: {event} for {mac}", "info"),
        _wifi(WIFI_RADIUS, "mac result", "radius_auth", "RADIUS authentication {result} for {mac}", "{type}",
              outcome="{outcome}", severity="{severity}",
              derive={"type": choose(one_of("result", "succeeded"), "start", "denied"),
                      "outcome": choose(one_of("result", "succeeded"), "success", "failure"),
                      "severity": choose(one_of("result", "succeeded"), "3", "7")}),
        _wifi(WIFI_ROAM, "mac from_if iface", "roam", "Wireless STA {mac} roamed {from_if} -> {iface}", "info",
              labels={"from_interface": "{from_if}", "to_interface": "{iface}"}),
    ))


def _dhcp(regex, groups, action, message, kind="info", outcome="success"):
    named = groups.split()
    fields = {"source_mac": "{mac}", "type": kind, "outcome": outcome}
    labels = {"dhcp_action": action, "interface?": "{iface}"}
    if "ip" in named:
        fields["source_ip"] = "{ip}"
    if "host" in named:
        labels["client_hostname?"] = "{host}"
    return Pattern(regex, groups, message=message, fields=fields, labels=labels)


DHCP = Parser(
    name="dhcp", dataset="unifi.dhcp", category="network", severity=2, tags="dhcp", keywords=DHCP_KEYWORDS,
    patterns=(
        _dhcp(DHCP_ACK, "iface ip mac host", "ack", "DHCP ACK: {ip} -> {mac} ({host|?})", "allowed"),
        _dhcp(DHCP_ACK_ISC, "ip mac host iface", "ack", "DHCP ACK: {ip} -> {mac}", "allowed"),
        _dhcp(DHCP_REQUEST, "iface ip mac host", "request", "DHCP REQUEST: {ip} from {mac}"),
        _dhcp(DHCP_REQUEST_ISC, "ip mac host iface", "request", "DHCP REQUEST: {ip} from {mac}"),
        _dhcp(DHCP_OFFER, "iface ip mac", "offer", "DHCP OFFER: {ip} to {mac}"),
        _dhcp(DHCP_DISCOVER, "iface mac host", "discover", "DHCP DISCOVER from {mac}"),
        _dhcp(DHCP_NAK, "iface ip mac", "nak", "DHCP NAK: {ip} to {mac}", "denied", "failure"),
        _dhcp(DHCP_RELEASE, "iface ip mac host", "release", "DHCP RELEASE: {ip} from {mac}"),
        _dhcp(DHCP_RELEASE_ISC, "ip mac host iface", "release", "DHCP RELEASE: {ip} from {mac}"),
    ))


def _dns(regex, groups, query_type, message, result="", outcome="success", severity=1, client="", upstream="",
         **derive):
    labels = {"query_type": query_type, "domain": "{domain253}"}
    if upstream:
        labels["upstream?"] = upstream
    if result:
        labels["result?"] = result
    return Pattern(regex, groups, message=message, severity=severity,
                   derive={"domain253": cut("domain", 253), **derive},
                   fields={"source_ip": client, "outcome": outcome, "type": "info"}, labels=labels)


DNS = Parser(
    name="dns", dataset="unifi.dns", category="network", severity=1, tags="dns", keywords=DNS_KEYWORDS,
    patterns=(
        _dns(DNS_BLOCKED, "domain ip", "blocked", "DNS blocked: {domain} from {ip|?}", result="blocked",
             outcome="failure", severity=6, client="{ip}"),
        _dns(DNS_NXDOMAIN, "domain", "A", "DNS NXDOMAIN: {domain}", result="NXDOMAIN", outcome="unknown",
             client="{asker}", asker=first_group(DNS_QUERY, 3)),
        _dns(DNS_QUERY, "qtype domain ip", "{kind}", "DNS query [{kind}] {domain} from {ip}", result="{answer128|queried}",
             client="{ip}", kind=upper("qtype"),
             answer128=lambda get: f"left({extract(DNS_REPLY, 2)}, 128)"),
        _dns(DNS_FORWARD, "domain upstream", "forward", "DNS forwarded {domain} to {upstream}",
             upstream="{upstream}"),
        _dns(DNS_CACHED, "domain answer", "cached", "DNS cached {domain} -> {answer}", result="{answer128}",
             answer128=cut("answer", 128)),
        _dns(DNS_REPLY, "domain answer", "reply", "DNS reply {domain} -> {answer}", result="{answer128}",
             answer128=cut("answer", 128)),
    ))


def _state_type(get):
    kinds = " ".join(f"WHEN '{state}' THEN '{kind}'" for state, kind in STATE_TYPE.items())
    return f"CASE upper({get('state')}) {kinds} ELSE 'info' END"


_ENDPOINTS = {"source_ip": "{src}", "dest_ip": "{dst}"}
_PORTS = {"source_port": "{spt}", "dest_port": "{dpt}"}
_SIZES = {"bytes": "{bytes}", "packets": "{pkts}"}


def _has_endpoint(regex, src, dst):
    return f"({extract(regex, src)} != '' OR {extract(regex, dst)} != '')"


TRAFFIC = Parser(
    name="traffic", dataset="unifi.traffic", category="network", severity=1, tags="traffic flow", claim="any",
    programs=("conntrack", "ulogd", "netflow", "ubnt-traffic", "flow"), keywords=TRAFFIC_KEYWORDS,
    defaults={"outcome": "success", "type": "info"},
    patterns=(
        Pattern(CONNTRACK_BRACKET, "state proto ct_state src dst spt dpt bytes pkts",
                message="Connection {state_low} {proto_low} {src}:{spt} -> {dst}:{dpt}",
                derive={"state_low": lower("state"), "state_up": upper("state"), "proto_low": lower("proto"),
                        "type": _state_type},
                fields={**_ENDPOINTS, **_PORTS, **_SIZES, "protocol": "{proto_low}", "type": "{type}"},
                labels={"conntrack_state": "{state_up}", "ct_state": "{ct_state}"}),
        Pattern(CONNTRACK, "state src dst spt dpt proto bytes pkts", also=_has_endpoint(CONNTRACK, 2, 3),
                message="Traffic {state_low}: {src|?} -> {dst|?}",
                derive={"state_low": lower("state"), "state_up": upper("state"), "proto_low": lower("proto"),
                        "type": _state_type},
                fields={**_ENDPOINTS, **_PORTS, **_SIZES, "protocol": "{proto_low}", "type": "{type}"},
                labels={"conntrack_state": "{state_up}"}),
        Pattern(TRAFFIC_STAT, "src dst bytes pkts dur proto", also=_has_endpoint(TRAFFIC_STAT, 1, 2),
                message="Traffic: {src|?} -> {dst|?} {bytes|0} bytes", derive={"proto_low": lower("proto")},
                fields={**_ENDPOINTS, **_SIZES, "protocol": "{proto_low}"}, labels={"duration_s": "{dur|0}"}),
        Pattern(NETFLOW, "src spt dst dpt proto bytes pkts", message="Flow: {src}:{spt} -> {dst}:{dpt}",
                derive={"proto_low": lower("proto")},
                fields={**_ENDPOINTS, **_PORTS, **_SIZES, "protocol": "{proto_low}"}),
    ))


def _wan(regex, groups, event, message, etype="info", outcome="success", severity=None, labels=None, ip="",
         iface="", gateway="", **derive):
    found = {"wan_event": event}
    if iface:
        found["interface?"] = iface
    if gateway:
        found["gateway?"] = gateway
    fields = {"type": etype, "outcome": outcome, "source_ip": ip}
    if event.startswith("pppoe"):
        fields["protocol"] = "pppoe"
    return Pattern(regex, groups, message=message, severity=severity, derive=derive, fields=fields,
                   labels={**found, **(labels or {})})


WAN = Parser(
    name="wan", dataset="unifi.wan", category="network", severity=4, tags="wan network", keywords=WAN_KEYWORDS,
    patterns=(
        _wan(PPPOE_CONNECT, "iface", "pppoe_connect", "PPPoE connected on {iface}{at}", "start",
             iface="{iface}", ip="{local}", local=first_group(PPPOE_IP, 1), at=phrase("local", " (", ")")),
        _wan(PPPOE_IP, "local remote", "pppoe_ip", "PPPoE IP: {local} gateway {remote}", ip="{local}",
             gateway="{remote}"),
        _wan(PPPOE_DOWN, "", "pppoe_disconnect", "PPPoE connection terminated", "end"),
        _wan(PPP_OK, "", "ppp_auth_success", "PPP authentication succeeded"),
        _wan(PPP_FAIL, "", "ppp_auth_failure", "PPP authentication failed", "denied", "failure", severity=6),
        _wan(WAN_BOUND, "ip sec", "dhcp_bound", "WAN DHCP bound to {ip}", "start", ip="{ip}",
             labels={"renewal_sec": "{sec}"}),
        _wan(WAN_ACK, "ip gw", "dhcp_ack", "WAN DHCP ACK: {ip} from {gw}", ip="{ip}", gateway="{gw}"),
        _wan(WAN_NO_OFFER, "", "dhcp_failure", "WAN DHCP: no offers received", "denied", "failure", severity=6),
        _wan(WAN_LINK, "iface state speed", "link_{low}", "WAN {iface} link {low}{at}", "{kind}",
             iface="{iface}", labels={"speed?": "{speed}"}, low=lower("state"), at=phrase("speed", " @ "),
             kind=choose(one_of("state", "up"), "start", "end")),
        _wan(WAN_FAILOVER, "iface", "wan_failover", "WAN failover{to}", severity=6, iface="{iface}",
             to=phrase("iface", " to ")),
        _wan(WAN_GATEWAY, "gw", "gateway_change", "Default gateway changed to {gw}", gateway="{gw}"),
    ))


def _port(regex, groups, event, message, etype="info", severity=None, labels=None, port="", **derive):
    found = {"port_event": event}
    if port:
        found["port_id?"] = port
    return Pattern(regex, groups, message=message, severity=severity, derive=derive,
                   fields={"type": etype, "outcome": "success"}, labels={**found, **(labels or {})})


PORT = Parser(
    name="port", dataset="unifi.port", category="network", severity=3, observer="switch", tags="port switch",
    keywords=PORT_KEYWORDS,
    patterns=(
        _port(MAC_FLAP, "mac from_port to_port", "mac_flap", "MAC flap: {mac} {from_port} -> {to_port}",
              severity=7, port="{to_port}",
              labels={"mac": "{mac}", "from_port": "{from_port}", "to_port": "{to_port}"}),
        _port(VIOLATION, "port mac", "security_violation", "Port security violation on {port|unknown}{by}",
              severity=8, port="{port}", labels={"port?": "{port}", "violating_mac?": "{mac}"},
              by=phrase("mac", " MAC ")),
        _port(BPDU, "port", "bpdu_guard", "BPDU guard triggered{on}", severity=7, port="{port}",
              on=phrase("port", " on port ")),
        _port(TOPOLOGY, "bridge", "stp_topology_change", "STP topology change{on}", severity=5,
              labels={"bridge": "{bridge}"}, on=phrase("bridge", " on ")),
        _port(STP_STATE, "port bridge state", "stp_state_change", "STP port {port} on {bridge} -> {state}",
              port="{port}", labels={"bridge": "{bridge}", "stp_state": "{state}"}),
        _port(SWITCH_LINK, "port state speed duplex", "port_link_{low}", "Port {port} link {low}{rate}", "{kind}",
              port="{port}", labels={"speed": "{speed}", "duplex": "{duplex}"}, low=lower("state"),
              rate=lambda get: f"CASE WHEN {get('speed')} = '' THEN '' "
                               f"ELSE concat(' ', {get('speed')}, ' ', {get('duplex')}) END",
              kind=choose(one_of("state", "up"), "start", "end")),
        _port(PORT_LINK, "port state", "port_link_{low}", "Port {port} {low}", "{kind}", port="{port}",
              low=lambda get: f"replace(lower({get('state')}), 'came ', '')",
              kind=choose(lambda get: f"{get('low')} RLIKE 'up|connect'", "start", "end")),
        _port(VLAN, "vid action port", "vlan_{low}", "VLAN {vid} {low}{on}", port="{port}", low=lower("action"),
              labels={"vlan_id": "{vid}", "vlan_action": "{low}"}, on=phrase("port", " on port ")),
        _port(POE, "port state", "poe_{low}", "PoE port {port} {low}", severity="{level}", port="{port}",
              low=lower("state"),
              level=choose(one_of("state", "overload", "fault"), "6", "2")),
    ))
