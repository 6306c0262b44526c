"""Request log: audit trail, rate limiting, user agents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUDITED_METHODS = ("POST", "PATCH", "DELETE", "PUT")  # Fixed values.
VERBS = {"POST": "create", "PATCH": "update", "PUT": "update", "DELETE": "delete"}  # Fixed values.
RATE_LIMIT, RATE_WINDOW, RATE_PATH = 100, 60, "/api/"  # Fixed values: requests, seconds, path prefix.
MIN_AGENT_LENGTH = 10  # Fixed value: shorter agent texts are not read.

# Families told apart, first match wins: name, pattern whose group 1 is the version.
BROWSERS = [("Edge", r"Edg(?:e|A|iOS)?/(\d+(?:\.\d+)*)"), ("Opera", r"(?:OPR|Opera)/(\d+(?:\.\d+)*)"),
            ("Firefox", r"(?:Firefox|FxiOS)/(\d+(?:\.\d+)*)"), ("Chrome", r"(?:Chrome|CriOS)/(\d+(?:\.\d+)*)"),
            ("Safari", r"Version/(\d+(?:\.\d+)*).*Safari/"), ("curl", r"^curl/(\d+(?:\.\d+)*)"),
            ("Python Requests", r"python-requests/(\d+(?:\.\d+)*)")]
SYSTEMS = [("Windows", r"Windows NT (\d+(?:\.\d+)*)"), ("iOS", r"(?:iPhone OS|CPU OS) (\d+(?:_\d+)*)"),
           ("Android", r"Android (\d+(?:\.\d+)*)"), ("Mac OS X", r"Mac OS X (\d+(?:[_.]\d+)*)"),
           ("Linux", r"Linux()")]
BOT = r"(?i)bot\b|crawler|spider|slurp|curl/|python-requests"
TABLET = r"iPad|Tablet|Android(?!.*Mobile)"
MOBILE = r"iPhone|iPod|Android.*Mobile|Windows Phone"
COMPUTER = r"Windows NT|Macintosh|X11|CrOS"


def derive_action(method: Column, path: Column) -> Column:
    verb = F.lower(method)
    for name, word in VERBS.items():
        verb = F.when(method == name, word).otherwise(verb)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.concat(verb, F.lit(":"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown")))


def client_ip(xff: Column, peer: Column) -> Column:
    return F.coalesce(F.when(xff != "", F.trim(F.split(xff, ",")[0])), peer, F.lit("unknown"))


def audit_log(requests: DataFrame) -> DataFrame:
    """One record per changing request."""
    return requests.filter(F.col("method").isin(*AUDITED_METHODS)).select(
        "id", "user_id", derive_action(F.col("method"), F.col("path")).alias("action"), "method", "path",
        F.col("status").alias("status_code"), client_ip(F.col("xff"), F.col("peer")).alias("ip_address"),
        "user_agent", F.col("ts").alias("created_at"))


def rate_limited(requests: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW,
                 prefix: str = RATE_PATH) -> DataFrame:
    """API requests beyond the ``limit``-th of their client in a fixed window.

    Only the first ``limit`` requests of a bucket are ranked: Spark drops the
    rest before the shuffle (window group limit). The limit-th one is then the
    cutoff that every request of the bucket is compared with, so a client that
    sends most of the traffic is never gathered in one task.
    """
    epoch = F.unix_seconds("ts")
    api = requests.filter(F.startswith("path", F.lit(prefix))).select(
        "id", "ts", client_ip(F.col("xff"), F.col("peer")).alias("client_ip"),
        (epoch - F.pmod(epoch, F.lit(window))).alias("bucket"))
    order = Window.partitionBy("client_ip", "bucket").orderBy("ts", "id")
    cutoff = (api.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
              .filter(F.col("rank") == limit)
              .select("client_ip", "bucket", F.struct("ts", "id").alias("last_allowed")))
    return (api.join(cutoff, ["client_ip", "bucket"])
            .filter(F.struct("ts", "id") > F.col("last_allowed"))
            .select("id", "ts", "client_ip", "bucket",
                    (F.lit(window) - F.pmod(F.unix_seconds("ts"), F.lit(window))).alias("retry_after")))


def _family(agent: Column, rules, version_sep: str = ".") -> Column:
    out = F.struct(F.lit("Other").alias("family"), F.lit("").alias("version"))
    for name, pattern in reversed(rules):
        version = F.translate(F.regexp_extract(agent, pattern, 1), "_", version_sep)
        out = F.when(agent.rlike(pattern), F.struct(F.lit(name).alias("family"), version.alias("version"))) \
            .otherwise(out)
    return out


def classify_user_agent(agent) -> Column:
    """Browser, system and device class; null for empty or very short texts."""
    agent = F.col(agent) if isinstance(agent, str) else agent
    tablet, mobile, bot = agent.rlike(TABLET), agent.rlike(MOBILE), agent.rlike(BOT)
    device = (F.when(bot, "Spider").when(agent.contains("iPad"), "iPad").when(agent.contains("iPhone"), "iPhone")
              .when(agent.contains("Macintosh"), "Mac").otherwise("Other"))
    return F.when(F.length(agent) >= MIN_AGENT_LENGTH, F.struct(
        _family(agent, BROWSERS).alias("browser"), _family(agent, SYSTEMS).alias("os"), device.alias("device"),
        bot.alias("is_bot"), (mobile & ~tablet).alias("is_mobile"), tablet.alias("is_tablet"),
        (agent.rlike(COMPUTER) & ~mobile & ~tablet).alias("is_pc")))


def user_agent_rollup(requests: DataFrame) -> DataFrame:
    ua = classify_user_agent("user_agent")
    return (requests.select(ua.alias("ua")).filter(F.col("ua").isNotNull())
            .groupBy(F.col("ua.browser.family").alias("browser"), F.col("ua.os.family").alias("os"),
                     F.col("ua.is_bot").alias("is_bot"), F.col("ua.is_mobile").alias("is_mobile"))
            .agg(F.count("*").alias("requests")))
