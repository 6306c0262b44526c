"""Log types in precedence order; the first that claims a line wins."""
from __future__ import annotations


from .access import ADMIN, AUTH, VPN
from .base import MOST_PATTERNS, Parser, Pattern
from .device import DEVICE, SYSTEM
from .network import DHCP, DNS, PORT, TRAFFIC, WAN, WIRELESS
from .security import FIREWALL, IDS, THREAT

# Fixed order.
DEFAULT_PARSERS: tuple[Parser, ...] = (
    IDS, THREAT, FIREWALL, AUTH, VPN, WIRELESS, DHCP, DNS, TRAFFIC, WAN, PORT, DEVICE, ADMIN, SYSTEM)


def register_parser(parsers: tuple[Parser, ...], parser: Parser, position: int) -> tuple[Parser, ...]:
    """Log types with ``parser`` placed at ``position``, which decides its precedence."""
    if any(p.name == parser.name for p in parsers):
        raise ValueError(f"log type {parser.name!r} already present")
    if len(parser.patterns) > MOST_PATTERNS:
        raise ValueError(f"log type {parser.name!r} has more than {MOST_PATTERNS} patterns")
    return parsers[:position] + (parser,) + parsers[position:]


__all__ = ["DEFAULT_PARSERS", "Parser", "Pattern", "register_parser"]
