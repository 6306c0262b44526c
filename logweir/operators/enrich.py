"""Lookups against dimensions: geo, threat intelligence, MAC vendor."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.network import ip_to_long, ip_to_pair, is_non_routable, long_to_pair, normalize_oui, pair_slice
from ..functions.predicates import field
from ..schema import GEO, THREAT
from ..session import BROADCAST_ROW_LIMIT, broadcast_if_bounded, within_rows

EXACT_SCORE, BLOCK_SCORE = 90, 85  # Fixed values.
_SLICE = 16


def split_ranges(ranges: DataFrame) -> DataFrame:
    """Cut (lo, hi) ranges at /16 borders and add the /16 number as ``slice``."""
    first, last = F.shiftright("lo", _SLICE), F.shiftright("hi", _SLICE)
    cut = ranges.withColumn("slice", F.explode(F.sequence(first, last)))
    size = 1 << _SLICE
    return cut.withColumns({"lo": F.greatest(F.col("lo"), F.col("slice") * size),
                            "hi": F.least(F.col("hi"), F.col("slice") * size + (size - 1))})


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """Overlapping blocks (lo, hi, length, feed, ord) to disjoint ranges (lo, hi, feed).

    Every address keeps the feed of the first block, by ``ord``, that covers
    it. Borders are looked up by equality on (length, prefix), never by
    comparing pairs of blocks, and each /16 is cut up on its own.
    """
    size = 1 << _SLICE
    parts = split_ranges(blocks.select("lo", "hi"))
    borders = parts.select("slice", F.explode(F.array("lo", F.col("hi") + 1)).alias("at")) \
        .filter(F.col("at") < (F.col("slice") + 1) * size).distinct()
    # A prefix of at most 33 lengths covers an address.
    lengths = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("length")

    def prefix(value: Column, length: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), F.lit(32) - length)).cast("long")

    keyed = borders.select("slice", "at", lengths)
    keyed = keyed.withColumn("prefix", prefix(F.col("at"), F.col("length")))
    named = blocks.groupBy("length", prefix(F.col("lo"), F.col("length")).alias("prefix")).agg(F.min("ord").alias("ord"))
    owner = keyed.join(named, ["length", "prefix"], "left").groupBy("slice", "at").agg(F.min("ord").alias("ord"))
    following = F.lead("at").over(Window.partitionBy("slice").orderBy("at"))
    return owner.select(F.col("at").alias("lo"),
                        (F.coalesce(following, (F.col("slice") + 1) * size) - 1).alias("hi"),
                        F.col("ord.feed").alias("feed")).filter(F.col("feed").isNotNull())


# Ranges in one /16 up to which an address is compared with each of them; with more it is searched for.
DENSE_SLICE = 64


def _found_at(index: tuple[np.ndarray, ...], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Position of the range that holds each address, -1 where there is none, by binary search of all at once."""
    start_hi, start_lo, end_hi, end_lo = index
    first, beyond = np.zeros(len(hi), np.int64), np.full(len(hi), len(start_hi), np.int64)
    while (first < beyond).any():
        middle = np.minimum((first + beyond) // 2, len(start_hi) - 1)
        after = (start_hi[middle] > hi) | ((start_hi[middle] == hi) & (start_lo[middle] > lo))
        open_ = first < beyond
        beyond = np.where(open_ & after, middle, beyond)
        first = np.where(open_ & ~after, middle + 1, first)
    at = first - 1
    if not len(start_hi):
        return at
    inside = (at >= 0) & ((end_hi[at] > hi) | ((end_hi[at] == hi) & (end_lo[at] >= lo)))
    return np.where(inside, at, -1)


def _indexed(df: DataFrame, pair: Column, ranges: DataFrame, payload: Column, name: str) -> DataFrame:
    """By an index: sorted starts of all ranges, broadcast and searched; the place found is joined to its payload."""
    spark = df.sparkSession
    rows = ranges.select(F.col("lo.hi").alias("lo_hi"), F.col("lo.lo").alias("lo_lo"), F.col("hi.hi").alias("hi_hi"), F.col("hi.lo").alias("hi_lo"),
                         payload.alias(name)).toArrow().sort_by([("lo_hi", "ascending"), ("lo_lo", "ascending")])
    index = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("lo_hi", "lo_lo", "hi_hi", "hi_lo")))

    # Missing addresses are told by a flag: a null would make pandas read the numbers as floats.
    @F.pandas_udf("long")
    def place(known: pd.Series, hi: pd.Series, lo: pd.Series) -> pd.Series:
        return pd.Series(np.where(known.to_numpy(bool), _found_at(index.value, hi.to_numpy(np.int64), lo.to_numpy(np.int64)), -1))
    schema = T.StructType([T.StructField("_at", T.LongType()), T.StructField(name, ranges.select(payload.alias(name)).schema[name].dataType)])
    named = rows.select([name]).add_column(0, "_at", pa.array(np.arange(len(rows)), pa.int64()))
    places = spark.createDataFrame(named, schema).withColumnRenamed("_at", "_place")
    halves = [F.coalesce(F.col(f"_pair.{half}"), F.lit(0).cast("long")) for half in ("hi", "lo")]
    keyed = df.withColumn("_pair", pair).withColumn("_at", place(F.col("_pair").isNotNull(), *halves))
    return keyed.join(F.broadcast(places), F.col("_at") == F.col("_place"), "left").select(*df.columns, name)


def _slice_parts(ranges: DataFrame) -> DataFrame:
    """Ranges of pairs cut at the borders of /16s."""
    first, last = pair_slice(F.col("lo")), pair_slice(F.col("hi"))
    six = F.lit(1 << 32)
    none = F.array().cast("array<long>")
    four = F.when(first < 65536, F.sequence(first, F.least(last, F.lit(65535).cast("long")))).otherwise(none)
    rest = F.when(last >= six, F.sequence(F.greatest(first, six), last)).otherwise(none)
    cut = ranges.withColumn("slice", F.explode(F.concat(four, rest)))
    least = F.lit(-(1 << 63))
    begin = F.when(F.col("slice") < six, long_to_pair(F.col("slice") * 65536)).otherwise(
        F.struct(F.shiftleft(F.col("slice") - six, 48).bitwiseXOR(least).alias("hi"), least.alias("lo")))
    # The end may lie in a later slice: no address of this one is beyond it.
    return cut.withColumn("lo", F.greatest("lo", begin))


def _merged(df: DataFrame, pair: Column, ranges: DataFrame, payload: Column, name: str) -> DataFrame:
    """By merging: distinct addresses and ranges of each /16 in address order, joined back by address. No pairs are formed."""
    parts = _slice_parts(ranges.select("lo", "hi", payload.alias(name)))
    addresses = df.select(pair.alias("at")).filter(F.col("at").isNotNull()).distinct()
    nothing = parts.schema[name].dataType
    merged = addresses.select(pair_slice(F.col("at")).alias("slice"), "at", F.lit(1).alias("is_ip"),
                              F.lit(None).cast(parts.schema["hi"].dataType).alias("hi"), F.lit(None).cast(nothing).alias(name)) \
        .unionByName(parts.select("slice", F.col("lo").alias("at"), F.lit(0).alias("is_ip"), "hi", name))
    latest = F.last(F.when(F.col("is_ip") == 0, F.struct("hi", name)), ignorenulls=True).over(
        Window.partitionBy("slice").orderBy("at", "is_ip").rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("r", latest).filter((F.col("is_ip") == 1) & (F.col("at") <= F.col("r.hi"))) \
        .select(F.col("at.hi").alias("_hi"), F.col("at.lo").alias("_lo"), F.lit(0).cast("long").alias("_apart"), F.col(f"r.{name}").alias(name))
    # Rows without an address match nothing; a number of their own keeps them from being one task's work.
    keyed = df.withColumn("_pair", pair).withColumns({
        "_hi": F.coalesce("_pair.hi", F.lit(0)), "_lo": F.coalesce("_pair.lo", F.lit(0)),
        "_apart": F.when(F.col("_pair").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))})
    return keyed.join(found, ["_hi", "_lo", "_apart"], "left").select(*df.columns, name)


def address_lookup(df: DataFrame, ip: Column, ranges: DataFrame, payload: Column, name: str,
                   limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Add ``name``: the payload of the disjoint range (lo, hi: pairs of either family) holding ``ip``, else null.

    Ranges within ``limit`` are an index that every task searches, in log n steps an address; events do not move. More are merged.
    """
    lookup = _indexed if within_rows(ranges, limit) else _merged
    return lookup(df, ip_to_pair(ip), ranges, payload, name)


def range_lookup(df: DataFrame, ip: Column, ranges: DataFrame, payload: Column, name: str,
                 limit: int = BROADCAST_ROW_LIMIT, dense: int = DENSE_SLICE) -> DataFrame:
    """As ``address_lookup`` for IPv4 ranges of numbers (lo, hi), and addresses of IPv4 alone.

    While no /16 has more than ``dense`` ranges they are broadcast by /16, without Python.
    """
    parts = split_ranges(ranges).select("slice", "lo", "hi", payload.alias(name))
    value = ip_to_long(ip)
    most = parts.groupBy("slice").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if most[0] <= limit and most[1] <= dense:
        keyed = df.withColumns({"_ip": value, "_slice": F.shiftright(value, _SLICE)})
        hit = (F.col("_slice") == F.col("slice")) & F.col("_ip").between(F.col("lo"), F.col("hi"))
        return keyed.join(F.broadcast(parts), hit, "left").select(*df.columns, name)
    pairs = ranges.select(long_to_pair(F.col("lo")).alias("lo"), long_to_pair(F.col("hi")).alias("hi"), payload.alias(name))
    lookup = _indexed if most[0] <= limit else _merged
    return lookup(df, long_to_pair(value), pairs, F.col(name), name)


def geo_struct() -> Column:
    location = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    return F.struct("country_iso_code", "country_name", "city_name", location.alias("location")).cast(GEO)


def enrich_geo(df: DataFrame, ranges: DataFrame | None, ip: str = "source.ip", name: str = "geo",
               limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Add the place of public addresses. Without ranges every place is null.

    ``ranges`` are of IPv4 numbers, or of both families, as ``geo_networks`` makes them.
    """
    if ranges is None:
        return df.withColumn(name, F.lit(None).cast(GEO))
    address = F.when(~is_non_routable(field(df, ip)), field(df, ip))
    if isinstance(ranges.schema["lo"].dataType, T.StructType):
        return address_lookup(df, address, ranges, geo_struct(), name, limit)
    return range_lookup(df, address, ranges, geo_struct(), name, limit)


def match_ip_exact(df: DataFrame, ips: DataFrame, ip: str = "source.ip", name: str = "exact") -> DataFrame:
    """Add the match of addresses listed as such, else null. ``ips`` has one row per address."""
    listed = ips.select(F.col("ip").alias("_listed"), F.struct(
        F.lit(True).alias("matched"), F.col("feed").alias("feed"), F.lit(EXACT_SCORE).alias("score"))
        .cast(THREAT).alias(name))
    return df.join(broadcast_if_bounded(listed), field(df, ip) == F.col("_listed"), "left").drop("_listed")


def match_ip_cidr(df: DataFrame, blocks: DataFrame, ip: str = "source.ip", name: str = "block",
                  limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Add the match of addresses inside a listed block, else null; the first block by feed and line."""
    payload = F.struct(F.lit(True).alias("matched"), F.col("feed"), F.lit(BLOCK_SCORE).alias("score")).cast(THREAT)
    return range_lookup(df, field(df, ip), flatten_blocks(blocks), payload, name, limit)


def enrich_threat(df: DataFrame, ips: DataFrame, blocks: DataFrame, ip: str = "source.ip",
                  name: str = "threat_intel") -> DataFrame:
    """Add the threat match: exact beats block, else not matched."""
    none = F.struct(F.lit(False).alias("matched"), F.lit(None).cast("string").alias("feed"),
                    F.lit(0).alias("score")).cast(THREAT)
    both = match_ip_cidr(match_ip_exact(df, ips, ip, "_exact"), blocks, ip, "_block")
    return both.withColumn(name, F.coalesce("_exact", "_block", none)).drop("_exact", "_block")


def with_feed_details(matches: DataFrame, catalog: DataFrame, feed: str = "feed") -> DataFrame:
    """Join tags and confidence of the matching feed. The catalogue is a handful of rows."""
    known = catalog.select(F.col("feed").alias("_feed"), "tags", "confidence")
    return matches.join(broadcast_if_bounded(known), F.col(feed) == F.col("_feed"), "left").drop("_feed")


def enrich_mac_vendor(df: DataFrame, oui: DataFrame, mac: str = "source.mac", name: str = "mac_vendor") -> DataFrame:
    known = oui.select(F.col("oui").alias("_oui"), F.col("vendor").alias(name))
    return df.join(broadcast_if_bounded(known), normalize_oui(field(df, mac)) == F.col("_oui"), "left").drop("_oui")


Enricher = Callable[[DataFrame], DataFrame]


def enrich_events(events: DataFrame, geo_ranges: DataFrame | None, ips: DataFrame, blocks: DataFrame,
                  oui: DataFrame, extra: tuple[Enricher, ...] = ()) -> DataFrame:
    """All lookups, written into the nested event; ``extra`` are further enrichers applied at the end."""
    out = enrich_geo(events, geo_ranges, name="_geo")
    out = enrich_threat(out, ips, blocks, name="_threat")
    out = enrich_mac_vendor(out, oui, name="_vendor")
    out = (out.withColumn("source", F.col("source").withField("geo", F.col("_geo"))
                          .withField("threat_intel", F.col("_threat")))
           .withColumn("observer", F.col("observer").withField("mac_vendor", F.col("_vendor")))
           .select(*events.columns))
    for enricher in extra:
        out = apply_enricher(out, enricher)
    return out


def apply_enricher(events: DataFrame, enricher: Enricher) -> DataFrame:
    """Run a user's enricher. It adds columns and must keep the ones it was given."""
    out = events.transform(enricher)
    lost = [c for c in events.columns if c not in out.columns]
    if lost:
        raise ValueError(f"enricher dropped columns {lost}")
    return out
