"""Addresses of both families and their ranges, against the standard library."""
import ipaddress
import random

from pyspark.sql import functions as F

from logweir.functions.network import ip_to_pair, network_bounds
from logweir.operators import enrich

HALF = 1 << 63


def number(pair):
    return ((pair["hi"] + HALF) << 64) + pair["lo"] + HALF


def meant(text):
    address = ipaddress.ip_address(text.split("%")[0])
    return int(address.ipv4_mapped if address.version == 6 and address.ipv4_mapped else address)


def test_addresses(spark):
    rng = random.Random(1)
    good = ["::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1%eth0", "64:ff9b::192.0.2.33", "1::", "255.255.255.255", "2001:DB8::A"]
    good += [str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(((1 << 48) - 1) << rng.randrange(80)))) for _ in range(100)]
    bad = ["1::2::3", "12345::", "1:2:3", "g::1", ":", "", "::1.2.3.400", "1:2:3:4:5:6:7:8:9", None, "a.b", "1:2:3:4:5:6:7::8:9"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", ip_to_pair("ip").alias("p")).collect()
    assert {r.ip: number(r.p) for r in rows if r.p} == {x: meant(x) for x in good}
    assert {r.ip for r in rows if r.p is None} == set(bad)


def test_networks(spark):
    good = ["2001:db8::/32", "2a00:1450:4001::/48", "10.1.2.3/8", "::/0", "1.2.3.4/32", "2001:db8:1:2:3::/70", "0.0.0.0/0", "2001:db8::/64", "2001::/63"]
    bad = ["x/3", "1.2.3.4/33", "::/129", "1.2.3.4/", None]
    lo, hi = network_bounds("n")
    rows = spark.createDataFrame([(x,) for x in good + bad], "n string").select("n", lo.alias("lo"), hi.alias("hi")).collect()
    nets = {x: ipaddress.ip_network(x, strict=False) for x in good}
    assert {r.n: (number(r.lo), number(r.hi)) for r in rows if r.lo} == {x: (int(n.network_address), int(n.broadcast_address)) for x, n in nets.items()}
    assert {r.n for r in rows if r.lo is None and r.hi is None} == set(bad)


def test_lookups_agree(spark):
    """Index and merge find the same ranges, with nulls, texts that are no address, and ranges over many /16s."""
    rng = random.Random(2)
    cuts = sorted(rng.sample(range(1 << 20), 400)) + [1 << 20]
    ranges = [((a << 12), (b << 12) - 1 - rng.choice([0, 5000]) if b - a > 2 else (b << 12) - 1, k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(600)] + [None] * 20 + ["x", "::1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string")
    table = spark.createDataFrame(ranges, "lo long, hi long, no int")

    def plain(text):
        try:
            value = int(ipaddress.IPv4Address(text))
        except ValueError:
            return None
        return next((no for lo, hi, no in ranges if lo <= value <= hi), None)
    want = {i: plain(x) for i, x in enumerate(ips)}
    for limit, dense in ((10 ** 6, 10 ** 6), (10 ** 6, 0), (0, 0)):
        found = enrich.range_lookup(df, F.col("ip"), table, F.col("no"), "no", limit, dense)
        assert {r.id: r.no for r in found.collect()} == want
    six = [(f"2a{k:02x}::/{rng.choice([16, 20, 40, 64])}", k) for k in range(0, 256, 3)] + [(f"10.{k}.0.0/17", 1000 + k) for k in range(40)]
    lo, hi = network_bounds("network")
    pairs = spark.createDataFrame(six, "network string, no int").select(lo.alias("lo"), hi.alias("hi"), "no")
    ips = [f"2a{rng.randrange(256):02x}:{rng.choice([0, 0, 0x800, 0x1000, 0xffff]):x}::{rng.randrange(9)}" for _ in range(300)] + [f"10.{rng.randrange(60)}.{rng.randrange(256)}.1" for _ in range(100)] + [None, "z"]
    nets = [(ipaddress.ip_network(x), no) for x, no in six]
    want = {i: next((no for n, no in nets if x and x != "z" and ipaddress.ip_address(x) in n), None) for i, x in enumerate(ips)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string")
    for limit in (10 ** 6, 0):
        found = enrich.address_lookup(df, F.col("ip"), pairs, F.col("no"), "no", limit)
        assert {r.id: r.no for r in found.collect()} == want


def test_dense_slice(spark):
    """A /16 with all its addresses listed alone, and no ranges at all."""
    df = spark.range(70_000).select("id", F.concat(F.lit("10.9."), F.floor(F.col("id") / 256) % 256, F.lit("."), F.col("id") % 256).alias("ip"))
    table = spark.range(0, 65_536).select((F.col("id") + (10 << 24) + (9 << 16)).alias("lo"), (F.col("id") + (10 << 24) + (9 << 16)).alias("hi"), F.col("id").alias("no"))
    assert enrich.range_lookup(df, F.col("ip"), table, F.col("no"), "no").filter("no = id % 65536").count() == 70_000
    assert enrich.range_lookup(df, F.col("ip"), table.limit(0), F.col("no"), "no", dense=-1).filter("no IS NULL").count() == 70_000
