"""IP and MAC address expressions. All run as built-in Spark expressions."""
from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that never get a location.
NON_ROUTABLE_V4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                   "169.254.0.0/16", "100.64.0.0/10"]
# IPv6 loopback, fc00::/7 and fe80::/10 as text prefixes.
NON_ROUTABLE_V6 = r"(?i)^(::1$|0{0,4}(:0{1,4}){6,7}:0{0,3}1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
# Networks that count as private for lateral movement (no 100.64.0.0/10).
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
              "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
# Exceptions that stay public inside 192.0.0.0/24.
PUBLIC_INSIDE_PRIVATE = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = r"(?i)^(::1?$|::ffff:0?|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:|100::)"

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(ip: Column) -> Column:
    return F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.try_cast("long"))


def ip_to_long(ip) -> Column:
    """Numeric value of a dotted IPv4 address, null when it is not one."""
    return once(_col(ip), lambda s: F.when(s.rlike(IPV4_PATTERN), _number(s)))


# Flips the sign bit, so that unsigned halves of an address compare as signed numbers.
_LEAST = -(1 << 63)


def _groups6(s: Column) -> Column:
    """The eight 16-bit groups of an IPv6 text, null when it is none. Text after % is a zone and is cut off."""
    bare = F.lower(F.substring_index(s, "%", 1))
    dotted = F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1)

    def unfolded(v4: Column) -> Column:
        """A dotted end as two groups."""
        ends = F.concat_ws(":", F.hex(F.shiftright(v4, 16)), F.hex(v4.bitwiseAND(F.lit(0xFFFF))))
        return F.when(dotted == "", bare).when(v4.isNotNull(), F.concat(F.substr(bare, F.lit(1), F.length(bare) - F.length(dotted)), F.lower(ends)))
    text = once(ip_to_long(dotted), unfolded)

    def groups(t: Column) -> Column:
        def side(part: Column) -> Column:
            return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
        left, right = side(F.substring_index(t, "::", 1)), side(F.substring_index(t, "::", -1))
        known = F.size(left) + F.size(right)
        short = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), right)
        once = F.size(F.split(t, "::")) == 2
        all_ = F.when(~F.contains(t, F.lit("::")), F.split(t, ":")).when(once & (known <= 7), short)
        return F.when((F.size(all_) == 8) & F.forall(all_, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                      F.transform(all_, lambda g: F.conv(g, 16, 10).cast("long")))
    return once(text, groups)


def _half(groups: Column, first: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(4):
        out = out.bitwiseOR(F.shiftleft(F.get(groups, F.lit(first + k)), 48 - 16 * k))
    return out.bitwiseXOR(F.lit(_LEAST))


def _pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def long_to_pair(value: Column) -> Column:
    """An IPv4 number as a pair."""
    return F.when(value.isNotNull(), _pair(F.lit(_LEAST), value.bitwiseXOR(F.lit(_LEAST))))


def ip_to_pair(ip) -> Column:
    """An address of either family as two numbers whose order is that of 128 bits; null when it is none.

    IPv4 addresses are the last 32 of 128 bits, and so are IPv4 addresses written as IPv6 (``::ffff:1.2.3.4``).
    """
    def six(s):
        def pair(g):
            mapped = (F.get(g, F.lit(5)) == 0xFFFF) & F.forall(F.slice(g, 1, 5), lambda x: x == 0)
            low = F.shiftleft(F.get(g, F.lit(6)), 16).bitwiseOR(F.get(g, F.lit(7)))
            return F.when(g.isNotNull(), F.when(mapped, long_to_pair(low)).otherwise(_pair(_half(g, 0), _half(g, 4))))
        return once(_groups6(s), pair)
    return once(_col(ip), lambda s: F.when(s.contains(":"), six(s)).otherwise(long_to_pair(ip_to_long(s))))


def pair_slice(pair: Column) -> Column:
    """Number of the /16 an address is in; those of IPv6 come after those of IPv4."""
    six = F.shiftrightunsigned(pair["hi"].bitwiseXOR(F.lit(_LEAST)), 48)
    return F.when(pair["hi"] == _LEAST, F.shiftright(pair["lo"].bitwiseXOR(F.lit(_LEAST)), 16)).otherwise(six + (1 << 32))


def network_bounds(network) -> tuple[Column, Column]:
    """First and last address of an IPv4 or IPv6 network, as pairs; null for a bad one. Host bits are allowed."""
    network = _col(network)
    pair = ip_to_pair(F.substring_index(network, "/", 1))
    width = F.when(F.contains(F.substring_index(network, "/", 1), F.lit(":")), 128).otherwise(32)
    length = F.substring_index(network, "/", -1).try_cast("int")
    free = width - length

    def mask(bits: Column) -> Column:
        """The lowest 0 to 64 bits set."""
        return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, F.lit(-1).cast("long")) \
            .otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)
    low, high = mask(F.least(free, F.lit(64))), mask(free - 64)
    ok = pair.isNotNull() & length.isNotNull() & (free >= 0) & (length >= 0)

    def bounds(half: str, bits: Column) -> tuple[Column, Column]:
        value = pair[half].bitwiseXOR(F.lit(_LEAST))
        first = value.bitwiseAND(F.bitwise_not(bits))
        return first.bitwiseXOR(F.lit(_LEAST)), first.bitwiseOR(bits).bitwiseXOR(F.lit(_LEAST))
    (hi_first, hi_last), (lo_first, lo_last) = bounds("hi", high), bounds("lo", low)
    return F.when(ok, _pair(hi_first, lo_first)), F.when(ok, _pair(hi_last, lo_last))


def long_to_ip(value) -> Column:
    value = _col(value)
    return F.concat_ws(".", *[F.shiftrightunsigned(value, s).bitwiseAND(F.lit(255)).cast("string")
                              for s in (24, 16, 8, 0)])


def _in_networks(value: Column, networks: list[str], but: list[str] = ()) -> Column:
    """Is the address in any of the networks?"""
    def any_of(v, listed):
        hit = F.lit(False)
        for text in listed:
            net = ipaddress.ip_network(text)
            hit = hit | v.between(int(net.network_address), int(net.broadcast_address))
        return hit
    return F.exists(F.array(value), lambda v: any_of(v, networks) & ~any_of(v, but) if but else any_of(v, networks))


def is_non_routable(ip) -> Column:
    """True for addresses the geo lookup skips; text that is no address counts as such."""
    def test(s):
        v6 = s.contains(":") & ~s.rlike(NON_ROUTABLE_V6)
        return F.when(s.rlike(IPV4_PATTERN), _in_networks(_number(s), NON_ROUTABLE_V4)).otherwise(~v6)
    return F.coalesce(once(_col(ip), test), F.lit(True))


def is_private(ip) -> Column:
    """True for addresses that are not globally reachable; false when it is no address."""
    def test(s):
        v4 = _in_networks(_number(s), PRIVATE_V4, PUBLIC_INSIDE_PRIVATE)
        return F.when(s.rlike(IPV4_PATTERN), v4).otherwise(s.contains(":") & s.rlike(PRIVATE_V6))
    return F.coalesce(once(_col(ip), test), F.lit(False))


def normalize_oui(mac) -> Column:
    return F.substring(F.translate(F.upper(_col(mac)), ":-.", ""), 1, 6)


def normalize_mac(mac) -> Column:
    return F.trim(F.translate(F.lower(_col(mac)), "-", ":"))


def cidr_bounds(cidr) -> tuple[Column, Column, Column]:
    """(first address, last address, prefix length); all null for a bad block. Host bits are allowed."""
    cidr = _col(cidr)
    base = ip_to_long(F.substring_index(cidr, "/", 1))
    length = F.substring_index(cidr, "/", -1).try_cast("int")
    ok = base.isNotNull() & length.between(0, 32)
    size = F.pow(F.lit(2), F.lit(32) - length).cast("long")
    lo = F.when(ok, base - F.pmod(base, size))
    return lo, F.when(ok, lo + size - 1), F.when(ok, length)
