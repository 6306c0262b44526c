"""Authentication, VPN and administration log types."""
from __future__ import annotations

from .base import Parser, Pattern, choose, cut, extract, like, one_of, strip

# Authentication patterns.
AUTH_KEYWORDS = (r"(?i)Failed password|Accepted password|Accepted publickey|Failed publickey|Invalid user"
                 r"|pam_unix.*authentication failure|FAILED LOGIN|authentication failure"
                 r"|session opened.*for user|session closed.*for user")
FAILED_PASSWORD = r"Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)"
ACCEPTED_PASSWORD = r"Accepted password for (\S+) from ([\d.]+) port (\d+)"
ACCEPTED_PUBLICKEY = r"Accepted publickey for (\S+) from ([\d.]+) port (\d+)"
FAILED_PUBLICKEY = r"Failed publickey for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)"
INVALID_USER = r"Invalid user (\S+) from ([\d.]+)(?:\s+port (\d+))?"
PAM_FAILURE = r"pam_unix\S*: authentication failure;.*?(?:user=(\S+))?.*?(?:rhost=([\d.]+))?"
PAM_SESSION = r"pam_unix\S*: session (opened|closed) for user (\S+)"
LOGIN_FAILED = r"FAILED LOGIN\s+\d+\s+FROM\s+(\S+)\s+FOR\s+(\S+)"
SUDO = r"sudo:\s+(\S+)\s+:.*?(?:COMMAND=(.+))?$"

# VPN patterns.
VPN_KEYWORDS = (r"(?i)openvpn|CONNECTED.*VPN|VPN.*DISCONNECTED|TLS: Initial packet|IKE_SA.*established"
                r"|ipsec.*established|L2TP tunnel|AUTH_FAILED|pptpd|xl2tpd|charon")
OVPN_UP = r"(?i)(\S+)/([\d.]+):(\d+)\s+(?:MULTI_sva:|CONNECTED|client connected)"
OVPN_DOWN = r"(?i)(\S+)/([\d.]+):(\d+)\s+(?:DISCONNECTED|client disconnected|Connection reset)"
OVPN_TLS = r"TLS: Initial packet from \[AF_INET\]([\d.]+):(\d+)"
OVPN_AUTH = r"(?i)(?:TLS Error|AUTH_FAILED|AUTH failed).*?(?:from \[AF_INET\]([\d.]+):(\d+))?"
OVPN_AUTH_ALSO = r"(?i)AUTH_FAILED|TLS Error"
OVPN_PEER = r"Peer Connection Initiated with \[AF_INET\]([\d.]+):(\d+)"
IPSEC_UP = r"(?i)connection '(\S+)' established successfully"
IPSEC_PEER = r"(?i)(?:peer|from)\s+([\d.]+(?:\[\d+\])?)"
IKE_UP = r"IKE_SA\s+\S+\[[\d]+\]\s+established\s+between\s+[\d.]+\[.*?\]\.\.\.\s*([\d.]+)"
IPSEC_DOWN = r"(?i)(?:connection '(\S+)' terminated|IKE_SA\s+\S+.*?deleted)"
IPSEC_AUTH = r"(?i)(?:AUTH_FAILED|authentication.*failed|IKE authentication.*failed).*?(?:from\s+([\d.]+))?"
L2TP_UP = r"(?i)L2TP tunnel (\S+) (?:established|up).*?(?:peer=([\d.]+))?"
L2TP_DOWN = r"(?i)L2TP tunnel (\S+) (?:closed|down|destroyed)"
PPTP_UP = r"(?i)pptpd.*?(?:connection from|CTRL:) ([\d.]+)"

# Administration patterns.
ADMIN_KEYWORDS = (r"(?i)admin\s+login|Admin login|user\s+logged\s+(?:in|out)|settings?\s+changed"
                  r"|device\s+provisi|device\s+adopted|firmware\s+upgrade|ubnt-util|mcad:")
ADMIN_OK = r"(?i)Admin login (?:succeeded|successful)[:\s]+(?:for\s+)?(\S+).*?from\s+([\d.]+)"
ADMIN_FAILED = r"(?i)Admin login (?:failed|failure)[:\s]+(?:for\s+)?(\S+).*?from\s+([\d.]+)"
MCAD_LOGIN = r"(?i)(?:admin|user)\s+(?:login|logged in)[:\s]+(?:user=)?(\S+).*?from\s+([\d.]+)"
MCAD_LOGOUT = r"(?i)(?:admin|user)\s+(?:logout|logged out)[:\s]+(?:user=)?(\S+)"
SETTINGS = r"(?i)settings?\s+changed?\s+(?:by\s+)?(\S+)(?:.*?at\s+([\d.]+))?"
PROVISION = r"(?i)(?:device\s+)?(?:provisiond?|adopted?)\s+([^(]+?)\s*\(([\da-f:]+)\)"
CONFIG_CHANGE = r"(?i)(\S+)\s+changed\s+from\s+(\S+)\s+to\s+(\S+)"
FIRMWARE = r"(?i)(?:firmware\s+)?upgrade\s+(?:initiated|started|completed).*?(?:on\s+)?(\S+)?"

_OK = {"outcome": "success", "type": "start"}
_FAIL = {"outcome": "failure", "type": "denied"}


def _login(regex: str, ok: bool, method: str, message: str, severity: int | None = None) -> Pattern:
    return Pattern(
        regex, "user ip port", message=message, severity=severity or (3 if ok else 7),
        fields={"user": "{user}", "source_ip": "{ip}", "source_port": "{port}", **(_OK if ok else _FAIL)},
        labels={"auth_method": method})


AUTH = Parser(
    name="auth", dataset="unifi.auth", category="authentication", tags="auth", keywords=AUTH_KEYWORDS,
    patterns=(
        _login(FAILED_PASSWORD, False, "password", "SSH failed password for {user} from {ip}"),
        _login(ACCEPTED_PASSWORD, True, "password", "SSH accepted password for {user} from {ip}"),
        _login(ACCEPTED_PUBLICKEY, True, "publickey", "SSH accepted publickey for {user} from {ip}"),
        _login(FAILED_PUBLICKEY, False, "publickey", "SSH failed publickey for {user} from {ip}"),
        _login(INVALID_USER, False, "unknown", "SSH invalid user {user} from {ip}", severity=8),
        # An empty address falls back to the sender of the datagram, see parse_logs.
        Pattern(PAM_FAILURE, "user ip", message="PAM authentication failure for {user|unknown}", severity=7,
                fields={"user": "{user}", "source_ip": "{ip|@sender}", **_FAIL}, labels={"auth_method": "pam"}),
        Pattern(PAM_SESSION, "action user", message="PAM session {action} for {user}", severity=2,
                derive={"type": choose(one_of("action", "opened"), "start", "end")},
                fields={"user": "{user}", "outcome": "success", "type": "{type}",
                        "category": "authentication session"}),
        Pattern(LOGIN_FAILED, "tty user", message="Login failed for {user}", severity=7,
                fields={"user": "{user}", **_FAIL}, labels={"auth_method": "local"}),
        Pattern(SUDO, "user cmd", message="sudo by {user}: {short}", severity=3,
                derive={"command": cut("cmd", 256), "short": cut("cmd", 128)},
                fields={"user": "{user}", "outcome": "success", "type": "info", "tags": "auth sudo"},
                labels={"command": "{command}"}),
    ))


def _vpn(regex: str, groups: str, protocol: str, message: str, kind: str, outcome: str,
         tunnel: str = "", severity: int | None = None, **more) -> Pattern:
    named = groups.split() + list(more.get("derive", {}))
    fields = {"protocol": protocol, "type": kind, "outcome": outcome, "tags": f"vpn {protocol}"}
    for name, slot in (("user", "user"), ("ip", "source_ip"), ("port", "source_port")):
        if name in named:
            fields[slot] = "{%s}" % name
    labels = {"vpn_protocol": protocol}
    if tunnel:
        labels["tunnel_id?"] = tunnel
    return Pattern(regex, groups, message=message, fields=fields, labels=labels, severity=severity, **more)


VPN = Parser(
    name="vpn", dataset="unifi.vpn", category="session network", severity=4, claim="any", keep_zero_port=True,
    programs=("openvpn", "charon", "ipsec", "pluto", "xl2tpd", "l2tpd", "pptpd", "strongswan"),
    keywords=VPN_KEYWORDS,
    patterns=(
        _vpn(OVPN_UP, "user ip port", "openvpn", "OpenVPN client {user} connected from {ip}", "start", "success"),
        _vpn(OVPN_DOWN, "user ip port", "openvpn", "OpenVPN client {user} disconnected from {ip}", "end", "success"),
        _vpn(OVPN_TLS, "ip port", "openvpn", "OpenVPN TLS handshake from {ip}", "info", "unknown"),
        _vpn(OVPN_AUTH, "ip", "openvpn", "OpenVPN authentication failed", "denied", "failure", severity=7,
             also=like(OVPN_AUTH_ALSO)),
        _vpn(OVPN_PEER, "ip port", "openvpn", "OpenVPN peer connection from {ip}", "info", "unknown",
             also="contains(lower(raw), 'openvpn')"),
        _vpn(IPSEC_UP, "tunnel", "ipsec", "IPsec tunnel {tunnel} established", "start", "success",
             tunnel="{tunnel}",
             derive={"ip": lambda get: f"substring_index({extract(IPSEC_PEER, 1)}, '[', 1)"}),
        _vpn(IKE_UP, "ip", "ipsec", "IPsec IKE_SA established with {ip}", "start", "success"),
        _vpn(IPSEC_DOWN, "tunnel", "ipsec", "IPsec tunnel {tunnel|unknown} terminated", "end", "success",
             tunnel="{tunnel}"),
        _vpn(IPSEC_AUTH, "ip", "ipsec", "IPsec authentication failed", "denied", "failure", severity=7),
        _vpn(L2TP_UP, "tunnel ip", "l2tp", "L2TP tunnel {tunnel} established", "start", "success",
             tunnel="{tunnel}"),
        _vpn(L2TP_DOWN, "tunnel", "l2tp", "L2TP tunnel {tunnel} closed", "end", "success", tunnel="{tunnel}"),
        _vpn(PPTP_UP, "ip", "pptp", "PPTP connection from {ip}", "start", "success"),
    ))


def _admin(regex: str, groups: str, action: str, message: str, ok: bool = True, severity: int | None = None,
           labels: dict | None = None, **more) -> Pattern:
    fields = {"outcome": "success", "type": "info"} if ok else _FAIL
    fields = {**fields, **{slot: "{%s}" % name for name, slot in (("user", "user"), ("ip", "source_ip"))
                           if name in groups.split()}}
    return Pattern(regex, groups, message=message, severity=severity, fields=fields,
                   labels={"admin_action": action, **(labels or {})}, **more)


ADMIN = Parser(
    name="admin", dataset="unifi.admin", category="authentication configuration", severity=4, tags="admin",
    claim="both", keywords=ADMIN_KEYWORDS,
    programs=("mcad", "ubnt-util", "unifi", "unifi-network", "ubnt-admin", "unifi-core", "unifi-protect",
              "network-application"),
    patterns=(
        _admin(ADMIN_OK, "user ip", "login", "Admin login succeeded for {user} from {ip}"),
        _admin(ADMIN_FAILED, "user ip", "login_failed", "Admin login failed for {user} from {ip}", ok=False,
               severity=7),
        _admin(MCAD_LOGIN, "user ip", "login", "Admin login: {user} from {ip}"),
        _admin(MCAD_LOGOUT, "user", "logout", "Admin logout: {user}"),
        _admin(SETTINGS, "user ip", "settings_change", "Settings changed by {user}", severity=5),
        _admin(PROVISION, "device_raw mac", "provision", "Device provisioned: {device} ({mac})",
               derive={"device": strip("device_raw")}, labels={"device": "{device}", "device_mac": "{mac}"}),
        _admin(CONFIG_CHANGE, "key old new", "config_change", "Config {key} changed: {old} -> {new}",
               derive={"old64": cut("old", 64), "new64": cut("new", 64)},
               labels={"config_key": "{key}", "old_value": "{old64}", "new_value": "{new64}"}),
        _admin(FIRMWARE, "device", "firmware_upgrade", "Firmware upgrade on {device|unknown}",
               labels={"target_device": "{device|unknown}"}),
    ))
