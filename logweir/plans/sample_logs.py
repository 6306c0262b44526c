"""Log lines written from the ``events`` table, with the fields each should be read as.

One line form per pattern of every log type. The expected fields are stated by
hand, so they check the parser rather than repeat it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample_events import duckdb_flat, events_flat

FIELDS = ("source_ip", "source_port", "source_mac", "dest_ip", "dest_port", "protocol", "direction", "bytes",
          "packets", "user", "outcome", "type", "severity", "message", "labels", "category", "tags")
# dataset, kind, category, observer, tags, outcome, type, severity of a line unless it says otherwise.
CONSTANTS = {
    "ids_ips": ("unifi.ids_ips", "alert", "intrusion_detection", "ids", "ids ips alert", "failure", "denied", "5"),
    "threat": ("unifi.threat", "alert", "intrusion_detection", "ids", "threat ips", "failure", "denied", "8"),
    "firewall": ("unifi.firewall", "event", "network", "firewall", "firewall", "failure", "denied", "7"),
    "auth": ("unifi.auth", "event", "authentication", "firewall", "auth", "failure", "denied", "7"),
    "vpn": ("unifi.vpn", "event", "session network", "firewall", "vpn", "success", "start", "4"),
    "wireless": ("unifi.wireless", "event", "session", "firewall", "wireless wifi", "success", "start", "2"),
    "dhcp": ("unifi.dhcp", "event", "network", "firewall", "dhcp", "success", "info", "2"),
    "dns": ("unifi.dns", "event", "network", "firewall", "dns", "success", "info", "1"),
    "traffic": ("unifi.traffic", "event", "network", "firewall", "traffic flow", "success", "info", "1"),
    "wan": ("unifi.wan", "event", "network", "firewall", "wan network", "success", "info", "4"),
    "port": ("unifi.port", "event", "network", "switch", "port switch", "success", "info", "3"),
    "device": ("unifi.device", "event", "configuration", "firewall", "device unifi", "success", "info", "4"),
    "admin": ("unifi.admin", "event", "authentication configuration", "firewall", "admin", "success", "info", "4"),
    "system": ("unifi.system", "event", "process", "host", "system", "unknown", "info", "5"),
}


def _s(parser: str, program: str, line: str, message: str, labels: str = "", **fields) -> tuple:
    return parser, program, line, {"message": message, "labels": labels, **fields}


_KV = "MAC={mac} SRC={ip} DST={dst} LEN=60 TTL=64 PROTO=TCP SPT={port} DPT={dport}"
_FW = dict(source_ip="{ip}", source_port="{port}", source_mac="{mac}", dest_ip="{dst}", dest_port="{dport}",
           protocol="tcp", bytes="60", packets="1")
_BLOCK = "Firewall blocked tcp {ip}:{port} -> {dst}:{dport}"
_ALLOW = "Firewall allowed tcp {ip}:{port} -> {dst}:{dport}"
_OK = dict(outcome="success", type="allowed", severity="3")
_STA = "wlan0: STA {mac} IEEE 802.11: "

SAMPLES = [
    # intrusion detection
    _s("ids_ips", "suricata", '{"event_type":"alert","src_ip":"{ip}","src_port":{port},"dest_ip":"{dst}",'
       '"dest_port":{dport},"proto":"TCP","alert":{"signature":"ET SCAN","signature_id":2001,"severity":1,'
       '"category":"Recon"}}', "Suricata alert: ET SCAN",
       "classification=Recon;priority=1;signature_id=2001;signature_name=ET SCAN", severity="9",
       source_ip="{ip}", source_port="{port}", dest_ip="{dst}", dest_port="{dport}", protocol="tcp"),
    _s("ids_ips", "snort", "[**] [1:2100498:7] GPL check returned root [**] [Classification: Potentially Bad Traffic] "
       "[Priority: 2] {TCP} {ip}:{port} -> {dst}:{dport}",
       "IDS/IPS alert [1:2100498:7]: GPL check returned root (Priority 2)",
       "classification=Potentially Bad Traffic;priority=2;signature_id=1:2100498:7;"
       "signature_name=GPL check returned root", severity="7",
       source_ip="{ip}", source_port="{port}", dest_ip="{dst}", dest_port="{dport}", protocol="tcp"),
    _s("ids_ips", "kernel", "snort: [**] [1:9:1] Odd host [**] SRC={ip} DST={dst}",
       "IDS/IPS alert [1:9:1]: Odd host (Priority 3)",
       "classification=unknown;priority=3;signature_id=1:9:1;signature_name=Odd host"),
    _s("ids_ips", "gwd", "IDS Alert: Port sweep; SRC:{ip} then DST:{dst}", "IDS alert: Port sweep",
       "classification=unknown;priority=3;signature_name=Port sweep", source_ip="{ip}", dest_ip="{dst}"),
    # threat management
    _s("threat", "kernel", "ubnt-threat-management BLOCK SRC={ip} DST={dst} threat=Mirai.Botnet url=http://x/y",
       "Threat blocked: Mirai.Botnet from {ip} to {dst}", "threat_name=Mirai.Botnet;url=http://x/y",
       source_ip="{ip}", dest_ip="{dst}"),
    _s("threat", "gwd", "threat-management: ALERT threat=Worm", "Threat detected: Worm from ? to ?",
       "threat_name=Worm;url=", outcome="unknown", type="info"),
    _s("threat", "gwd", "[IPS] Blocked {ip} - Evil.Thing", "IPS blocked: Evil.Thing from {ip}",
       "threat_name=Evil.Thing", source_ip="{ip}"),
    _s("threat", "gwd", "malware detected: Emotet came from {ip}", "Malware detected: Emotet from {ip}",
       "threat_name=Emotet", severity="9", source_ip="{ip}"),
    _s("threat", "gwd", "DPI: BLOCKED p2p flow src={ip} dst={dst}", "DPI blocked: p2p from {ip}",
       "dpi_category=p2p;threat_name=p2p", source_ip="{ip}", dest_ip="{dst}"),
    _s("threat", "honeypot", "honeypot was triggered from {ip}", "Honeypot triggered from unknown",
       "threat_name=honeypot_trigger", severity="9", outcome="unknown", type="info"),
    _s("threat", "gwd", "Blocked Worm.X threat from {ip}", "Threat blocked: Worm.X from {ip}", "threat_name=Worm.X",
       source_ip="{ip}"),
    # firewall
    _s("firewall", "kernel", "[UFW BLOCK] IN=eth0 OUT= " + _KV, _BLOCK, direction="inbound", **_FW),
    _s("firewall", "kernel", "[UFW ALLOW] IN=br0 OUT=eth0 " + _KV, _ALLOW, direction="outbound", **_FW, **_OK),
    _s("firewall", "gwd", "[ACL-WAN-LOCAL-D-4] IN=eth0 OUT=br0 " + _KV, _BLOCK, direction="inbound", **_FW),
    _s("firewall", "gwd", "[WAN_LOCAL-A-1] IN=br0 OUT=br1 " + _KV, _ALLOW, direction="internal", **_FW, **_OK),
    _s("firewall", "kernel", "[ACCEPT] IN= OUT=ppp0 SRC={ip} DST={dst} PROTO=ICMP TYPE=8",
       "Firewall allowed icmp {ip}:? -> {dst}:?", direction="outbound", source_ip="{ip}", dest_ip="{dst}",
       protocol="icmp", **_OK),
    _s("firewall", "kernel", "dropped SRC={ip} DST={dst} PROTO=UDP DPT={dport}",
       "Firewall blocked udp {ip}:? -> {dst}:{dport}", source_ip="{ip}", dest_ip="{dst}", dest_port="{dport}",
       protocol="udp"),
    # authentication
    _s("auth", "sshd[77]", "Failed password for invalid user {user} from {ip} port {port} ssh2",
       "SSH failed password for {user} from {ip}", "auth_method=password", source_ip="{ip}", source_port="{port}",
       user="{user}"),
    _s("auth", "sshd[77]", "Accepted password for {user} from {ip} port {port} ssh2",
       "SSH accepted password for {user} from {ip}", "auth_method=password", source_ip="{ip}", source_port="{port}",
       user="{user}", outcome="success", type="start", severity="3"),
    _s("auth", "sshd[77]", "Accepted publickey for {user} from {ip} port {port} ssh2: RSA",
       "SSH accepted publickey for {user} from {ip}", "auth_method=publickey", source_ip="{ip}",
       source_port="{port}", user="{user}", outcome="success", type="start", severity="3"),
    _s("auth", "sshd[77]", "Failed publickey for {user} from {ip} port {port} ssh2",
       "SSH failed publickey for {user} from {ip}", "auth_method=publickey", source_ip="{ip}", source_port="{port}",
       user="{user}"),
    _s("auth", "sshd[77]", "Invalid user {user} from {ip}", "SSH invalid user {user} from {ip}",
       "auth_method=unknown", source_ip="{ip}", user="{user}", severity="8"),
    _s("auth", "sshd[77]", "pam_unix(sshd:auth): authentication failure; logname= rhost={ip} user={user}",
       "PAM authentication failure for unknown", "auth_method=pam", source_ip="{sender}"),
    _s("auth", "sshd[77]", "pam_unix(sshd:session): session opened for user {user} by (uid=0)",
       "PAM session opened for {user}", user="{user}", outcome="success", type="start", severity="2",
       category="authentication session"),
    _s("auth", "sshd[77]", "pam_unix(sshd:session): session closed for user {user}",
       "PAM session closed for {user}", user="{user}", outcome="success", type="end", severity="2",
       category="authentication session"),
    _s("auth", "login[9]", "FAILED LOGIN 3 FROM tty1 FOR {user}", "Login failed for {user}", "auth_method=local",
       user="{user}"),
    _s("auth", "sudo", "{user} : authentication failure ; TTY=pts/0 ; COMMAND=/bin/ls -l",
       "sudo by {user}: /bin/ls -l", "command=/bin/ls -l", user="{user}", outcome="success", type="info", severity="3", tags="auth sudo"),
    # VPN
    _s("vpn", "openvpn[5]", "{user}/{ip}:{port} CONNECTED", "OpenVPN client {user} connected from {ip}",
       "vpn_protocol=openvpn", source_ip="{ip}", source_port="{port}", user="{user}", protocol="openvpn",
       tags="vpn openvpn"),
    _s("vpn", "openvpn[5]", "{user}/{ip}:{port} Connection reset", "OpenVPN client {user} disconnected from {ip}",
       "vpn_protocol=openvpn", source_ip="{ip}", source_port="{port}", user="{user}", protocol="openvpn", type="end",
       tags="vpn openvpn"),
    _s("vpn", "openvpn[5]", "TLS: Initial packet from [AF_INET]{ip}:{port}", "OpenVPN TLS handshake from {ip}",
       "vpn_protocol=openvpn", source_ip="{ip}", source_port="{port}", protocol="openvpn", type="info",
       outcome="unknown", tags="vpn openvpn"),
    _s("vpn", "openvpn[5]", "AUTH_FAILED from [AF_INET]{ip}:{port}", "OpenVPN authentication failed",
       "vpn_protocol=openvpn", protocol="openvpn", type="denied", outcome="failure", severity="7",
       tags="vpn openvpn"),
    _s("vpn", "openvpn[5]", "Peer Connection Initiated with [AF_INET]{ip}:{port}",
       "OpenVPN peer connection from {ip}", "vpn_protocol=openvpn", source_ip="{ip}", source_port="{port}",
       protocol="openvpn", type="info", outcome="unknown", tags="vpn openvpn"),
    _s("vpn", "charon", "connection 'site-a' established successfully with peer {ip}[500]",
       "IPsec tunnel site-a established", "tunnel_id=site-a;vpn_protocol=ipsec", source_ip="{ip}", protocol="ipsec",
       tags="vpn ipsec"),
    _s("vpn", "charon", "IKE_SA site[3] established between 10.1.1.1[gw]...{ip}[peer]",
       "IPsec IKE_SA established with {ip}", "vpn_protocol=ipsec", source_ip="{ip}", protocol="ipsec",
       tags="vpn ipsec"),
    _s("vpn", "charon", "connection 'site-a' terminated", "IPsec tunnel site-a terminated",
       "tunnel_id=site-a;vpn_protocol=ipsec", protocol="ipsec", type="end", tags="vpn ipsec"),
    _s("vpn", "charon", "IKE authentication with {ip} failed", "IPsec authentication failed", "vpn_protocol=ipsec",
       protocol="ipsec", type="denied", outcome="failure", severity="7", tags="vpn ipsec"),
    _s("vpn", "xl2tpd", "L2TP tunnel 42 established peer={ip}", "L2TP tunnel 42 established",
       "tunnel_id=42;vpn_protocol=l2tp", protocol="l2tp", tags="vpn l2tp"),
    _s("vpn", "xl2tpd", "L2TP tunnel 42 closed", "L2TP tunnel 42 closed", "tunnel_id=42;vpn_protocol=l2tp",
       protocol="l2tp", type="end", tags="vpn l2tp"),
    _s("vpn", "pptpd", "connection from {ip}", "PPTP connection from {ip}", "vpn_protocol=pptp", source_ip="{ip}",
       protocol="pptp", tags="vpn pptp"),
    # wireless
    _s("wireless", "hostapd", _STA + "authenticated signal=-61 dBm", "Wireless STA {mac} authenticated on wlan0",
       "interface=wlan0;signal_dbm=-61;wifi_action=authenticated", source_mac="{mac}"),
    _s("wireless", "hostapd", _STA + "associated (aid 3) SSID='Guest Net'", "Wireless STA {mac} associated on wlan0",
       "interface=wlan0;ssid=Guest Net;wifi_action=associated", source_mac="{mac}"),
    _s("wireless", "hostapd", _STA + "associated BSSID=aa:bb:cc:00:11:22", "Wireless STA {mac} associated on wlan0",
       "bssid=aa:bb:cc:00:11:22;interface=wlan0;ssid=aa:bb:cc:00:11:22;wifi_action=associated", source_mac="{mac}"),
    _s("wireless", "hostapd", _STA + "disassociated reason=8", "Wireless STA {mac} disassociated from wlan0",
       "interface=wlan0;reason_code=8;wifi_action=disassociated", source_mac="{mac}", type="end"),
    _s("wireless", "hostapd", _STA + "deauthenticated due to inactivity (idle for 300 seconds)",
       "Wireless STA {mac} deauthenticated from wlan0: inactivity", "interface=wlan0;wifi_action=deauthenticated",
       source_mac="{mac}", type="end"),
    _s("wireless", "hostapd", "wlan0: STA {mac} WPA: pairwise key handshake completed (RSN)",
       "WPA: pairwise key handshake completed (RSN) for {mac}", "interface=wlan0;wifi_action=wpa_handshake",
       source_mac="{mac}", type="info"),
    _s("wireless", "hostapd", "STA {mac}: RADIUS authentication failed", "RADIUS authentication failed for {mac}",
       "wifi_action=radius_auth", source_mac="{mac}", type="denied", outcome="failure", severity="7"),
    _s("wireless", "hostapd", "STA {mac}: RADIUS authentication succeeded",
       "RADIUS authentication succeeded for {mac}", "wifi_action=radius_auth", source_mac="{mac}", severity="3"),
    _s("wireless", "hostapd", "Roaming STA {mac} IEEE 802.11 from wlan0 to wlan1",
       "Wireless STA {mac} roamed wlan0 -> wlan1",
       "from_interface=wlan0;interface=wlan1;to_interface=wlan1;wifi_action=roam", source_mac="{mac}", type="info"),
    # DHCP
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPACK(br0) {ip} {mac} laptop", "DHCP ACK: {ip} -> {mac} (laptop)",
       "client_hostname=laptop;dhcp_action=ack;interface=br0", source_ip="{ip}", source_mac="{mac}", type="allowed"),
    _s("dhcp", "dhcpd", "DHCPACK on {ip} to {mac} (laptop) via eth0", "DHCP ACK: {ip} -> {mac}",
       "client_hostname=laptop;dhcp_action=ack;interface=eth0", source_ip="{ip}", source_mac="{mac}",
       type="allowed"),
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPREQUEST(br0) {ip} {mac}", "DHCP REQUEST: {ip} from {mac}",
       "dhcp_action=request;interface=br0", source_ip="{ip}", source_mac="{mac}"),
    _s("dhcp", "dhcpd", "DHCPREQUEST for {ip} from {mac} via eth0", "DHCP REQUEST: {ip} from {mac}",
       "dhcp_action=request;interface=eth0", source_ip="{ip}", source_mac="{mac}"),
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPOFFER(br0) {ip} {mac}", "DHCP OFFER: {ip} to {mac}",
       "dhcp_action=offer;interface=br0", source_ip="{ip}", source_mac="{mac}"),
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPDISCOVER(br0) {mac} phone", "DHCP DISCOVER from {mac}",
       "client_hostname=phone;dhcp_action=discover;interface=br0", source_mac="{mac}"),
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPNAK(br0) {ip} {mac} wrong address", "DHCP NAK: {ip} to {mac}",
       "dhcp_action=nak;interface=br0", source_ip="{ip}", source_mac="{mac}", type="denied", outcome="failure"),
    _s("dhcp", "dnsmasq-dhcp[3]", "DHCPRELEASE(br0) {ip} {mac} phone", "DHCP RELEASE: {ip} from {mac}",
       "client_hostname=phone;dhcp_action=release;interface=br0", source_ip="{ip}", source_mac="{mac}"),
    _s("dhcp", "dhcpd", "DHCPRELEASE of {ip} from {mac} (phone) via eth0", "DHCP RELEASE: {ip} from {mac}",
       "client_hostname=phone;dhcp_action=release;interface=eth0", source_ip="{ip}", source_mac="{mac}"),
    # DNS
    _s("dns", "dnsmasq[8]", "query[A] bad.example blocked ads.example from {ip}",
       "DNS blocked: ads.example from {ip}", "domain=ads.example;query_type=blocked;result=blocked",
       source_ip="{ip}", outcome="failure", severity="6"),
    _s("dns", "dnsmasq[8]", "reply gone.example is NXDOMAIN", "DNS NXDOMAIN: gone.example",
       "domain=gone.example;query_type=A;result=NXDOMAIN", outcome="unknown"),
    _s("dns", "dnsmasq[8]", "query[aaaa] h{k}.example from {ip}", "DNS query [AAAA] h{k}.example from {ip}",
       "domain=h{k}.example;query_type=AAAA;result=queried", source_ip="{ip}"),
    _s("dns", "dnsmasq[8]", "query[A] h.example from {ip} reply h.example is 9.9.9.9",
       "DNS query [A] h.example from {ip}", "domain=h.example;query_type=A;result=9.9.9.9", source_ip="{ip}"),
    _s("dns", "dnsmasq[8]", "forwarded h.example to 8.8.8.8", "DNS forwarded h.example to 8.8.8.8",
       "domain=h.example;query_type=forward;upstream=8.8.8.8"),
    _s("dns", "dnsmasq[8]", "cached h.example is {dst}", "DNS cached h.example -> {dst}",
       "domain=h.example;query_type=cached;result={dst}"),
    _s("dns", "dnsmasq[8]", "reply h.example is <CNAME>", "DNS reply h.example -> <CNAME>",
       "domain=h.example;query_type=reply;result=<CNAME>"),
    # traffic
    _s("traffic", "conntrack", "[UPDATE] tcp 6 431980 ESTABLISHED src={ip} dst={dst} sport={port} dport={dport} "
       "packets=3 bytes=900", "Connection update tcp {ip}:{port} -> {dst}:{dport}",
       "conntrack_state=UPDATE;ct_state=ESTABLISHED", source_ip="{ip}", source_port="{port}", dest_ip="{dst}",
       dest_port="{dport}", protocol="tcp"),
    _s("traffic", "conntrack", "NEW src={ip} dst={dst} sport={port} dport={dport} proto=UDP bytes=900 packets=3",
       "Traffic new: {ip} -> {dst}", "conntrack_state=NEW", source_ip="{ip}", source_port="{port}", dest_ip="{dst}",
       dest_port="{dport}", protocol="udp", bytes="900", packets="3", type="start"),
    _s("traffic", "conntrack", "DESTROYED dst={dst}", "Traffic destroyed: ? -> {dst}", "conntrack_state=DESTROYED",
       dest_ip="{dst}", type="end"),
    _s("traffic", "ubnt-traffic", "src={ip} dst={dst} bytes=5000 pkts=10 dur=60",
       "Traffic: ? -> {dst} 5000 bytes", "duration_s=60", dest_ip="{dst}", bytes="5000", packets="10"),
    _s("traffic", "netflow", "{ip}:{port} -> {dst}:{dport} [TCP] 1500 bytes 4 pkts",
       "Flow: {ip}:{port} -> {dst}:{dport}", source_ip="{ip}", source_port="{port}", dest_ip="{dst}",
       dest_port="{dport}", protocol="tcp", bytes="1500", packets="4"),
    # WAN
    _s("wan", "pppd", "Connect: ppp0 <--> /dev/ttyS0", "PPPoE connected on ppp0",
       "interface=ppp0;wan_event=pppoe_connect", protocol="pppoe", type="start"),
    _s("wan", "pppd", "local IP address {ip} / remote IP address {dst}", "PPPoE IP: {ip} gateway {dst}",
       "gateway={dst};wan_event=pppoe_ip", source_ip="{ip}", protocol="pppoe"),
    _s("wan", "pppd", "Modem hangup", "PPPoE connection terminated", "wan_event=pppoe_disconnect",
       protocol="pppoe", type="end"),
    _s("wan", "wand", "PPPoE CHAP authentication succeeded", "PPP authentication succeeded",
       "wan_event=ppp_auth_success"),
    _s("wan", "wand", "PPPoE PAP authentication failed", "PPP authentication failed", "wan_event=ppp_auth_failure",
       type="denied", outcome="failure", severity="6"),
    _s("wan", "dhclient", "bound to {ip} -- renewal in 300 seconds", "WAN DHCP bound to {ip}",
       "renewal_sec=300;wan_event=dhcp_bound", source_ip="{ip}", type="start"),
    _s("wan", "networkd", "eth0: Link is Up 1000Mbps", "WAN eth0 link up @ 1000Mbps",
       "interface=eth0;speed=1000Mbps;wan_event=link_up", type="start"),
    _s("wan", "networkd", "ppp0: Link is Down", "WAN ppp0 link down", "interface=ppp0;wan_event=link_down",
       type="end"),
    _s("wan", "wan-monitor", "WAN failover to eth1", "WAN failover", "wan_event=wan_failover", severity="6"),
    _s("wan", "wand", "PPPoE default gateway changed to {dst}", "Default gateway changed to {dst}",
       "gateway={dst};wan_event=gateway_change"),
    # switch ports
    _s("port", "switch", "MAC flap MAC {mac} moved from 1/1 to 1/2", "MAC flap: {mac} 1/1 -> 1/2",
       "from_port=1/1;mac={mac};port_event=mac_flap;port_id=1/2;to_port=1/2", severity="7"),
    _s("port", "switch", "security violation port 7", "Port security violation on unknown",
       "port_event=security_violation", severity="8"),
    _s("port", "switch", "BPDU guard triggered on port 5", "BPDU guard triggered", "port_event=bpdu_guard",
       severity="7"),
    _s("port", "stp", "topology change sent on br0", "STP topology change",
       "bridge=;port_event=stp_topology_change", severity="5"),
    _s("port", "stp", "port 3 on br0 entering FORWARDING state", "STP port 3 on br0 -> FORWARDING",
       "bridge=br0;port_event=stp_state_change;port_id=3;stp_state=FORWARDING"),
    _s("port", "swconfig", "port 4 link up speed=1000M duplex=full", "Port 4 link up 1000M full",
       "duplex=full;port_event=port_link_up;port_id=4;speed=1000M", type="start"),
    _s("port", "switch", "VLAN 20 added on port 6", "VLAN 20 added on port 6",
       "port_event=vlan_added;port_id=6;vlan_action=added;vlan_id=20"),
    _s("port", "switch", "PoE port 9 overload", "PoE port 9 overload", "port_event=poe_overload;port_id=9",
       severity="6"),
    # devices
    _s("device", "ubnt-discovery", "device adopted: MAC {mac} IP {ip} model UAP-AC-Pro", "Device adopted: {mac}",
       "device_action=adopted;device_mac={mac}", source_mac="{mac}"),
    _s("device", "ubnt-discovery", "device discovered: {mac}", "Device discovered: {mac}",
       "device_action=discovered;device_mac={mac}", source_mac="{mac}"),
    _s("device", "unifi-device", "device provisioned {mac}", "Device provisioned: {mac}",
       "device_action=provisioned;device_mac={mac}", source_mac="{mac}"),
    _s("device", "unifi-device", "device forgot by admin", "Device forgotten: unknown", "device_action=forgot",
       severity="5"),
    _s("device", "unifi-device", "device {mac} upgraded to firmware 6.5.28", "Device {mac} upgraded to firmware 6.5.28",
       "device_action=firmware_upgrade;device_mac={mac};firmware_version=6.5.28", source_mac="{mac}"),
    _s("device", "unifi-device", "device {mac} rebooted", "Device {mac} rebooted",
       "device_action=reboot;device_mac={mac}", source_mac="{mac}", severity="5"),
    _s("device", "unifi-device", "{mac} state changed to Disconnected", "Device {mac} state -> disconnected",
       "device_action=state_disconnected;device_mac={mac};device_state=disconnected", source_mac="{mac}",
       severity="5"),
    # administration
    _s("admin", "ubnt-util", "Admin login succeeded for {user} from {ip}", "Admin login succeeded for {user} from {ip}",
       "admin_action=login", source_ip="{ip}", user="{user}"),
    _s("admin", "mcad", "Admin login failed: for {user} from {ip}", "Admin login failed for {user} from {ip}",
       "admin_action=login_failed", source_ip="{ip}", user="{user}", outcome="failure", type="denied", severity="7"),
    _s("admin", "mcad", "admin login: user={user} from {ip}", "Admin login: {user} from {ip}", "admin_action=login",
       source_ip="{ip}", user="{user}"),
    _s("admin", "mcad", "admin logout: user={user}", "Admin logout: {user}", "admin_action=logout", user="{user}"),
    _s("admin", "mcad", "settings changed by {user} at {ip}", "Settings changed by {user}",
       "admin_action=settings_change", source_ip="{ip}", user="{user}", severity="5"),
    _s("admin", "mcad", "adopted Living Room AP ({mac})", "Device provisioned: Living Room AP ({mac})",
       "admin_action=provision;device=Living Room AP;device_mac={mac}"),
    _s("admin", "mcad", "dns.server changed from 1.1.1.1 to 9.9.9.9", "Config dns.server changed: 1.1.1.1 -> 9.9.9.9",
       "admin_action=config_change;config_key=dns.server;new_value=9.9.9.9;old_value=1.1.1.1"),
    _s("admin", "mcad", "firmware upgrade started on AP-7", "Firmware upgrade on unknown",
       "admin_action=firmware_upgrade;target_device=unknown"),
    # host system
    _s("system", "oomd", "Out of memory: Kill process 812 (java) score 900", "OOM: killed process java (pid 812)",
       "killed_pid=812;killed_process=java;oom_score=900;system_event_type=oom_kill", severity="9"),
    _s("system", "oomd", "oom-kill:constraint=NONE,task=java,pid=812,uid=0", "OOM kill: java (pid 812)",
       "killed_pid=812;killed_process=java;system_event_type=oom_kill", severity="9"),
    _s("system", "hostd", "Kernel panic - not syncing", "Kernel panic detected", "system_event_type=kernel_panic",
       severity="10"),
    _s("system", "mcelog", "MCE 4 reported", "Hardware error: MCE 4", "system_event_type=hardware_error",
       severity="9"),
    _s("system", "hostd", "CPU3: Core temperature above threshold, cpu clock down",
       "CPU3 temperature above threshold", "cpu=3;system_event_type=cpu_thermal", severity="7"),
    _s("system", "hostd", "No space left on device", "Disk full: no space left on device",
       "system_event_type=disk_full", severity="8"),
    _s("system", "hostd", "Buffer I/O error on device sda1", "Disk I/O error on unknown",
       "device=unknown;system_event_type=disk_io_error", severity="8"),
    _s("system", "hostd", "nginx[44]: segfault at 7f00", "Segfault in nginx at 7f00",
       "address=7f00;pid=44;process=nginx;system_event_type=segfault", severity="6"),
    _s("system", "systemd[1]", "Started Session Service.", "Service started: Session Service",
       "service=Session Service;system_event_type=service_start", severity="2"),
    _s("system", "systemd[1]", "Stopped Cache Service.", "Service stopped: Cache Service",
       "service=Cache Service;system_event_type=service_stop", severity="3"),
    _s("system", "systemd[1]", "Failed to start Cache Service.", "Service failed: Cache Service",
       "service=Cache Service;system_event_type=service_failed", severity="7"),
    _s("system", "hostd", "lan7: Link is Up", "Interface lan7 link up",
       "interface=lan7;system_event_type=link_up", severity="4"),
    _s("system", "hostd", "watchdog timeout", "Watchdog reset/timeout", "system_event_type=watchdog_reset",
       severity="8"),
    # set aside: claimed but not readable, and claimed by nobody
    _s("firewall", "kernel", "Out of memory: Kill process 1 (init) score 1", ""),
    _s("dhcp", "dhclient", "No DHCPOFFERS received", ""),
    _s("", "cron[2]", "job {k} finished", ""),
]
UNREADABLE = 3  # the last samples have no fields

_VALUES = {"ip": "source_ip", "dst": "dest_ip", "mac": "mac", "user": "concat('user', cast(uid AS {str}))",
           "port": "cast(source_port AS {str})", "dport": "cast(dest_port AS {str})", "k": "cast(k AS {str})",
           "sender": "'10.255.0.1'"}
_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def expected(number: int) -> dict[str, str | None]:
    """Field templates of a sample; null where the event has no value."""
    parser, _, _, fields = SAMPLES[number]
    if number >= len(SAMPLES) - UNREADABLE:
        return {name: None for name in FIELDS}
    _, _, category, _, tags, outcome, kind, severity = CONSTANTS[parser]
    base = {"category": category, "tags": tags, "outcome": outcome, "type": kind, "severity": severity,
            "direction": "unknown", "bytes": "0", "packets": "0"}
    return {name: {**base, **fields}.get(name) for name in FIELDS}


def _quote(text: str, dialect: str) -> str:
    if dialect == "duckdb":
        return "'" + text.replace("'", "''") + "'"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _filled(template: str, dialect: str) -> str:
    """SQL text for a template over the flat event columns."""
    kind = "VARCHAR" if dialect == "duckdb" else "string"
    out = _quote(template, dialect)
    for name, value in _VALUES.items():
        if "{%s}" % name in template:
            out = f"replace({out}, '{{{name}}}', {value.format(str=kind)})"
    return out


def _chosen(templates: list[str | None], dialect: str) -> str:
    """SQL that picks the template of the row's sample."""
    items = " ".join(f"WHEN {i} THEN {'NULL' if t is None else _filled(t, dialect)}" for i, t in enumerate(templates))
    return f"CASE sample {items} END"


def events_as_syslog(events: DataFrame) -> DataFrame:
    """Raw log envelopes, one per event; the sample is the event id modulo their number."""
    chosen = _chosen([f"{program}: {text}" for _, program, text, _ in SAMPLES], "spark")
    # Under a lambda, as the parser's own long CASE.
    line = F.expr(f"transform(array({chosen}), v -> v)[0]")
    head = F.concat(F.lit("<134>"), F.date_format("event_ts", "MMM"), F.lit(" "),
                    F.lpad(F.dayofmonth("event_ts").cast("string"), 2, " "), F.lit(" "),
                    F.date_format("event_ts", "HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(" "))
    flat = events_flat(events).withColumn("sample", F.expr(f"cast(event_id % {len(SAMPLES)} AS int)"))
    # Held like the parser's own long expressions, or each pattern would write the line anew.
    return flat.select("id", F.explode_outer(F.array(F.concat(head, line))).alias("raw"),
                       (F.col("event_ts") + F.expr("interval 1 second")).alias("received_at"),
                       F.lit("10.255.0.1").alias("source_ip"))


def duckdb_expected() -> str:
    """The fields every line should be read as."""
    columns = [f"{_chosen([expected(i)[name] for i in range(len(SAMPLES))], 'duckdb')} AS want_{name}"
               for name in FIELDS]
    parser = _chosen([s[0] or None for s in SAMPLES], "duckdb")
    reason = _chosen([None] * (len(SAMPLES) - UNREADABLE) + ["parse_failed", "parse_failed", "no_parser"], "duckdb")
    flat = f"SELECT *, cast(event_id % {len(SAMPLES)} AS int) AS sample FROM ({duckdb_flat()})"
    return f"SELECT *, {parser} AS parser, {reason} AS reason, {', '.join(columns)} FROM ({flat})"
