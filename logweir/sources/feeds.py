"""Dimension tables: threat feeds, feed catalogue, MAC vendors, geo ranges."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.network import cidr_bounds, network_bounds, normalize_oui

CIDR_LINE, IP_LINE, COMMENT_LINE = r"^[\d.]+/\d+$", r"^[\d.]+$", r"^\s*[#;]"  # Fixed values.
FEED_FORMATS = ("plain_ip", "plain_cidr", "csv_ip_port", "csv_ip_domain", "urlhaus_json")  # Fixed values.

# Feed name, format, file stem, refresh hours, tags, confidence.
FEED_CATALOG = [
    ("feodo_tracker", "plain_ip", "feodo", 6, ["botnet", "c2", "malware"], "high"),
    ("emerging_threats_compromised", "plain_ip", "emerging_threats", 12, ["compromised", "scanner", "attacker"], "medium"),
    ("abuse_ch_sslbl", "csv_ip_port", "sslbl", 6, ["malware", "ssl", "c2", "phishing"], "high"),
    ("spamhaus_drop", "plain_cidr", "spamhaus_drop", 24, ["spam", "hijacked", "drop"], "high"),
    ("spamhaus_edrop", "plain_cidr", "spamhaus_edrop", 24, ["spam", "hijacked", "drop"], "high"),
    ("abuse_ch_urlhaus", "urlhaus_json", "urlhaus", 2, ["malware", "distribution", "dropper"], "high"),
    ("blocklist_de_bruteforce", "plain_ip", "blocklist_de", 12, ["bruteforce", "ssh", "rdp", "scanner"], "medium"),
]

# Built-in vendors by the first three octets.
BUILTIN_OUI = {
    "0418D6": "Ubiquiti Networks",
    "246895": "Ubiquiti Networks",
    "44D9E7": "Ubiquiti Networks",
    "687289": "Ubiquiti Networks",
    "785125": "Ubiquiti Networks",
    "802AA8": "Ubiquiti Networks",
    "DC9FDB": "Ubiquiti Networks",
    "F09FC2": "Ubiquiti Networks",
    "000000": "Xerox",
    "001451": "Apple",
    "0016CB": "Apple",
    "001E52": "Apple",
    "001F5B": "Apple",
    "0021E9": "Apple",
    "0023DF": "Apple",
    "002500": "Apple",
    "0026B9": "Apple",
    "0026BB": "Apple",
    "689C70": "Apple",
    "8C2937": "Apple",
    "A8BE27": "Apple",
    "F0B479": "Apple",
    "B827EB": "Raspberry Pi Foundation",
    "DCA632": "Raspberry Pi Foundation",
    "E45F01": "Raspberry Pi Foundation",
    "001B21": "Intel",
    "001CC0": "Intel",
    "0021D8": "Intel",
    "001632": "Samsung Electronics",
    "0021D1": "Samsung Electronics",
    "002339": "Samsung Electronics",
    "F4F5DB": "Google",
    "641666": "Google",
    "A47733": "Google",
    "AC63BE": "Amazon Technologies",
    "40B4CD": "Amazon Technologies",
    "001120": "Cisco Systems",
    "0012DA": "Cisco Systems",
    "001301": "Cisco Systems",
    "647002": "TP-Link Technologies",
    "6CB0CE": "TP-Link Technologies",
    "14CC20": "TP-Link Technologies",
    "08BD43": "Netgear",
    "9CD36D": "Netgear",
    "C40415": "Netgear",
}


def feed_entries(lines: DataFrame) -> DataFrame:
    """(feed, line_no, line) to (feed, line_no, kind, entry): comments cut, each line an IP, a CIDR or ignored."""
    text = F.trim(F.split(F.col("line"), "[#;]")[0])
    kind = F.when(text.rlike(CIDR_LINE), "cidr").when(text.rlike(IP_LINE), "ip")
    return (lines.filter(~F.col("line").rlike(COMMENT_LINE))
            .select("feed", "line_no", kind.alias("kind"), text.alias("entry")).filter(F.col("kind").isNotNull()))


def feed_ips(entries: DataFrame) -> DataFrame:
    """(ip, feed): one row per address, the feed first by name."""
    return entries.filter(F.col("kind") == "ip").groupBy(F.col("entry").alias("ip")).agg(F.min("feed").alias("feed"))


def feed_cidrs(entries: DataFrame) -> DataFrame:
    """(lo, hi, length, feed, ord): valid blocks, ordered by feed name and line."""
    lo, hi, length = cidr_bounds("entry")
    order = F.struct(F.col("feed"), F.col("line_no"))
    return (entries.filter(F.col("kind") == "cidr")
            .select(lo.alias("lo"), hi.alias("hi"), length.alias("length"), "feed", order.alias("ord"))
            .filter(F.col("lo").isNotNull()))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_feed_plain(spark: SparkSession, folder: str, names: str = "*.txt") -> DataFrame:
    """Lines of every file in the folder that is named like ``names`` as (feed, line_no, line); feed is the file's stem.

    One file is one row here, which keeps the lines numbered; block lists are
    small files, so nothing large passes through a task.
    """
    files = spark.read.option("pathGlobFilter", names).text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return files.select(stem.alias("feed"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def read_feed_csv(spark: SparkSession, path: str, layout: str, feed: str) -> DataFrame:
    """First two columns of a CSV feed: (feed, line_no, line, detail)."""
    if layout not in ("csv_ip_port", "csv_ip_domain"):
        raise ValueError(f"unknown feed layout {layout!r}")
    names = ["ip", "port" if layout == "csv_ip_port" else "domain"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("comment", "#").option("mode", "PERMISSIVE").schema(schema).csv(path)
    return rows.select(F.lit(feed).alias("feed"), F.monotonically_increasing_id().alias("line_no"),
                       F.trim("ip").alias("line"), F.trim(names[1]).alias("detail"))


def read_feed_json(spark: SparkSession, path: str, feed: str = "urlhaus") -> DataFrame:
    """URL hosts of a JSON feed that maps ids to lists of ``{"url": ...}``."""
    schema = "map<string, array<struct<url string>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    urls = docs.select(F.explode("m").alias("id", "items")).select("id", F.explode("items").alias("u"))
    return urls.select(F.lit(feed).alias("feed"), F.col("id").try_cast("long").alias("line_no"),
                       url_host(F.col("u.url")).alias("line"))


def url_host(url):
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^\[|\]$", "")


def feed_catalog(spark: SparkSession, only_enabled: bool = True, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Feed metadata, keyed by the file stem that matches carry."""
    rows = [(n, f, s, h, n not in disabled, t, c) for n, f, s, h, t, c in FEED_CATALOG]
    df = spark.createDataFrame(rows, "name string, format string, feed string, update_interval_hours int, "
                                     "enabled boolean, tags array<string>, confidence string")
    return df.filter("enabled") if only_enabled else df


def load_feed_catalog(spark: SparkSession, path: str, only_enabled: bool = True) -> DataFrame:
    """Feed metadata from a YAML catalogue: as ``feed_catalog``, and the ``file`` that holds each feed.

    The file's stem is what matches carry. An unknown format raises. The catalogue is a handful of entries.
    """
    import yaml
    text = spark.read.text(path, wholetext=True).first()
    rows = []
    for entry in (yaml.safe_load(text["value"]) or {}).get("feeds", []) if text else []:
        if entry["format"] not in FEED_FORMATS:
            raise ValueError(f"unknown feed format {entry['format']!r}; must be one of {FEED_FORMATS}")
        file = entry["local_path"].rsplit("/", 1)[-1]
        rows.append((entry["name"], entry["format"], file.rsplit(".", 1)[0], file, entry.get("update_interval_hours"), bool(entry.get("enabled", True)),
                     list(entry.get("tags") or []), entry.get("confidence")))
    df = spark.createDataFrame(rows, "name string, format string, feed string, file string, update_interval_hours int, enabled boolean, "
                                     "tags array<string>, confidence string")
    return df.filter("enabled") if only_enabled else df


def read_catalog_feeds(spark: SparkSession, catalog: DataFrame, folder: str) -> DataFrame:
    """(feed, line_no, line) of every file of ``catalog`` in ``folder``, each read as its format says. Files that are missing are skipped."""
    out = spark.createDataFrame([], "feed string, line_no long, line string")
    for entry in catalog.select("feed", "format", "file").collect():
        path = f"{folder}/{entry['file']}"
        if not exists(spark, path):
            continue
        if entry["format"].startswith("plain_"):
            lines = read_feed_plain(spark, path, "*").withColumn("feed", F.lit(entry["feed"]))
        elif entry["format"].startswith("csv_"):
            lines = read_feed_csv(spark, path, entry["format"], entry["feed"])
        else:
            lines = read_feed_json(spark, path, entry["feed"])
        out = out.unionByName(lines.select("feed", F.col("line_no").cast("long").alias("line_no"), "line"))
    return out


def builtin_oui(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUILTIN_OUI.items()), "oui string, vendor string")


def read_oui(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Vendors by prefix; a downloaded row replaces the built-in one."""
    base = builtin_oui(spark).withColumn("rank", F.lit(0).cast("long"))
    if path:
        rows = spark.read.schema("macPrefix string, vendorName string").option("multiLine", True).json(path)
        loaded = rows.select(normalize_oui("macPrefix").alias("oui"), F.col("vendorName").alias("vendor"),
                             (F.monotonically_increasing_id() + 1).alias("rank"))
        base = base.unionByName(loaded.filter((F.col("oui") != "") & (F.col("vendor") != "")))
    return base.groupBy("oui").agg(F.max_by("vendor", "rank").alias("vendor"))


def read_geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Disjoint IPv4 ranges (lo, hi) with their place."""
    return spark.read.schema("lo long, hi long, country_iso_code string, country_name string, city_name string, "
                             "lat double, lon double").parquet(path)


def geo_networks(rows: DataFrame) -> DataFrame:
    """Ranges of both address families from disjoint networks: ``rows`` has network (text) and the columns of a place.

    Bad networks are left out.
    """
    lo, hi = network_bounds("network")
    return rows.withColumns({"lo": lo, "hi": hi}).filter(F.col("lo").isNotNull()).drop("network")
