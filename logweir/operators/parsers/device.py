"""Managed device and host system log types."""
from __future__ import annotations

from .base import Parser, Pattern, choose, cut, lower, one_of, phrase, strip, text

# Device patterns.
DEVICE_KEYWORDS = (r"(?i)device\s+(?:adopted|provisioned|forgot|discovered)|ubnt.*(?:adopted|provisioned)"
                   r"|(?:state\s+changed\s+to|is\s+now)\s+(?:connected|disconnected|isolated)"
                   r"|device.*upgraded.*firmware|device.*rebooted")
ADOPTED = (r"(?i)(?:device\s+adopted|ubnt.*adopted).*?(?:MAC\s+)?([\da-f:]{17}).*?(?:IP\s+([\d.]+))?.*?"
           r"(?:model\s+([A-Z0-9\-]+))?")
DISCOVERED = (r"(?i)(?:discovered|new device detected).*?(?:MAC\s+)?([\da-f:]{17}).*?(?:IP\s+([\d.]+))?.*?"
              r"(?:model\s+([A-Z0-9\-]+))?")
PROVISIONED = (r"(?i)(?:device\s+provisioned|ubnt.*provisioned).*?(?:MAC\s+)?([\da-f:]{17}).*?"
               r"(?:IP\s+([\d.]+))?")
FORGOTTEN = r"(?i)(?:device\s+(?:forgot|forgotten|removed|deleted)).*?(?:MAC\s+)?([\da-f:]{17})?"
UPGRADED = r"(?i)device\s+([\da-f:]{17})\s+upgraded.*?firmware\s+([\d.]+)"
REBOOTED = r"(?i)device\s+([\da-f:]{17})\s+(?:rebooted|restarted|reset)"
STATE = r"(?i)([\da-f:]{17})\s+(?:state\s+changed\s+to|is\s+now)\s+(\S+)"

# System patterns.
SYSTEM_KEYWORDS = (r"(?i)Out of memory:|oom-kill:|Core temperature above|No space left|I/O error|Buffer I/O error"
                   r"|SCSI error|systemd.*Started|systemd.*Failed|systemd.*Stopped|segfault at|Kernel panic"
                   r"|MCE\s+\d+|watchdog.*(?:reset|timeout)|Link is (?:Up|Down)")
OOM = r"(?i)Out of memory:\s+Kill process (\d+) \(([^)]+)\) score (\d+)"
OOM_NEW = r"(?i)oom-kill:.*?task=([^,]+),pid=(\d+)"
PANIC = r"(?i)Kernel panic"
HARDWARE = r"(?i)(MCE\s+\d+|Hardware Error|ECC\s+error|parity\s+error|NMI\s+watchdog)"
CPU_HOT = r"(?i)CPU(\d+):\s+(?:Core temperature|Package temperature)\s+above threshold"
THROTTLED = r"(?i)(?:thermal|cpu).*?throttl(?:ed|ing)"
DISK_FULL = r"(?i)(?:No space left on device|write error.*ENOSPC|disk.*full)"
DISK_ERROR = r"(?i)(?:I/O error|SCSI error|Buffer I/O error).*?(?:device\s+(\S+))?"
SEGFAULT = r"(?i)(\S+)\[(\d+)\]:\s+segfault at (\S+)"
STARTED = r"(?i)systemd.*?Started\s+(.+?)\.?$"
STOPPED = r"(?i)systemd.*?(?:Stopped|Failed\s+to\s+start|Deactivated)\s+(.+?)\.?$"
LINK = r"(?i)(\w+(?:\.\d+)?): Link is (Up|Down)"
WATCHDOG = r"(?i)watchdog.*?(?:reset|timeout|bite)"


def _says(word: str) -> str:
    return f"contains(lower(raw), {text(word)})"


def _device(regex, groups, action, message, severity=None, labels=None, also=None, **derive):
    named = groups.split()
    found = {"device_action": action, "device_mac?": "{mac}"}
    fields = {"source_mac": "{mac}", "outcome": "success", "type": "info"}
    if "ip" in named:
        found["device_ip?"] = "{ip}"
        fields["source_ip"] = "{ip}"
    if "model" in named:
        found["device_model?"] = "{model}"
    return Pattern(regex, groups, message=message, severity=severity, derive=derive, also=also, fields=fields,
                   labels={**found, **(labels or {})})


DEVICE = Parser(
    name="device", dataset="unifi.device", category="configuration", severity=4, tags="device unifi",
    claim="both", keywords=DEVICE_KEYWORDS,
    programs=("ubnt-discovery", "ubnt", "unifi-device", "ubnt-util", "unifi-network", "unifi-core"),
    patterns=(
        _device(ADOPTED, "mac ip model", "adopted", "Device adopted: {mac}{kind}", also=_says("adopt"),
                kind=phrase("model", " (", ")")),
        _device(DISCOVERED, "mac ip model", "discovered", "Device discovered: {mac}{kind}",
                also=_says("discover"), kind=phrase("model", " (", ")")),
        _device(PROVISIONED, "mac ip", "provisioned", "Device provisioned: {mac}"),
        _device(FORGOTTEN, "mac", "forgot", "Device forgotten: {mac|unknown}", severity=5),
        _device(UPGRADED, "mac fw", "firmware_upgrade", "Device {mac} upgraded to firmware {fw}",
                labels={"firmware_version": "{fw}"}),
        _device(REBOOTED, "mac", "reboot", "Device {mac} rebooted", severity=5),
        _device(STATE, "mac state", "state_{low}", "Device {mac} state -> {low}", severity="{level}",
                labels={"device_state": "{low}"}, low=lower("state"),
                level=choose(one_of("state", "disconnected", "isolated"), "5", "3")),
    ))


def _system(regex, groups, event, message, severity, labels=None, **derive):
    return Pattern(regex, groups, message=message, severity=severity, derive=derive,
                   labels={"system_event_type": event, **(labels or {})})


def _failed(yes: str, no: str):
    return choose(lambda get: _says("fail"), yes, no)


SYSTEM = Parser(
    name="system", dataset="unifi.system", category="process", observer="host", tags="system",
    keywords=SYSTEM_KEYWORDS, defaults={"outcome": "unknown", "type": "info"},
    patterns=(
        _system(OOM, "pid proc score", "oom_kill", "OOM: killed process {proc} (pid {pid})", 9,
                {"killed_process": "{proc}", "killed_pid": "{pid}", "oom_score": "{score}"}),
        _system(OOM_NEW, "proc pid", "oom_kill", "OOM kill: {proc} (pid {pid})", 9,
                {"killed_process": "{proc}", "killed_pid": "{pid}"}),
        _system(PANIC, "", "kernel_panic", "Kernel panic detected", 10),
        _system(HARDWARE, "what", "hardware_error", "Hardware error: {what128}", 9,
                what128=cut("what", 128)),
        _system(CPU_HOT, "cpu", "cpu_thermal", "CPU{cpu} temperature above threshold", 7, {"cpu": "{cpu}"}),
        _system(THROTTLED, "", "cpu_throttle", "CPU throttled due to thermal event", 6),
        _system(DISK_FULL, "", "disk_full", "Disk full: no space left on device", 8),
        _system(DISK_ERROR, "dev", "disk_io_error", "Disk I/O error on {dev|unknown}", 8,
                {"device": "{dev|unknown}"}),
        _system(SEGFAULT, "prog pid addr", "segfault", "Segfault in {prog} at {addr}", 6,
                {"process": "{prog}", "pid": "{pid}", "address": "{addr}"}),
        _system(STARTED, "unit", "service_start", "Service started: {service}", 2, {"service": "{service}"},
                service=strip("unit")),
        _system(STOPPED, "unit", "{kind}", "Service {verb}: {service}", "{level}", {"service": "{service}"},
                service=strip("unit"), kind=_failed("service_failed", "service_stop"),
                verb=_failed("failed", "stopped"), level=_failed("7", "3")),
        _system(LINK, "iface state", "link_{low}", "Interface {iface} link {low}", 4, {"interface": "{iface}"},
                low=lower("state")),
        _system(WATCHDOG, "", "watchdog_reset", "Watchdog reset/timeout", 8),
    ))
