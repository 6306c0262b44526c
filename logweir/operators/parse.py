"""Raw lines to nested events: header, classification, extraction, normalisation.

Everything is column expressions over one row, so the job is a narrow
map over the source's partitions: no shuffle and no Python worker.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.network import once
from ..schema import EVENT, GEO, THREAT
from .parsers import DEFAULT_PARSERS, Parser
from .parsers.base import MOST_PATTERNS, TEXT_FIELDS, UNIX_LINES

# Header forms, month names and observer identity.
PRI = r"^<\d+>"
HEADER_ISO = (r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+"
              r"(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+\s+(.+)")
HEADER_BSD = (r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+"
              r"(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.+)")
PROGRAM_HOST = r"^(?:<\d+>)?(?:\S+ +\S+ +\S+ +)?(\S+)\s+([a-zA-Z0-9_\-]+)(?:\[\d+\])?:"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
OBSERVER_NAME, OBSERVER_VENDOR = "unifi", "Ubiquiti"

_PER_PARSER = MOST_PATTERNS + 1
SENDER = "@sender"


def strip_pri(raw) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.trim(F.regexp_replace(raw, PRI, ""))


def header(raw: Column, received_at: Column) -> Column:
    """Struct (ts, host, program, message). A line without a known header is all message.

    Lines that carry a protocol version digit after the priority have no known
    header here and keep their whole text as the message.
    """
    def read(line: Column) -> Column:
        def iso(n):
            return F.regexp_extract(line, UNIX_LINES + HEADER_ISO, n)

        def bsd(n):
            return F.regexp_extract(line, UNIX_LINES + HEADER_BSD, n)

        def dated(pieces: Column) -> Column:
            """Time of month, day, hour, minute and second in the year that is not in the future."""
            month = F.get(pieces, F.lit(0))

            def at_year(year):
                return F.try_make_timestamp(year, *[F.get(pieces, F.lit(n)) for n in range(4)], F.get(pieces, F.lit(4)).cast("decimal(16,6)"))
            return once(at_year(F.year(received_at)), lambda this_year: F.when(
                (this_year > received_at) & (month > F.month(received_at)), at_year(F.year(received_at) - 1)).otherwise(this_year))

        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), bsd(1)).cast("int")
        bsd_ts = once(F.array(month, *[bsd(n).try_cast("int") for n in (2, 3, 4, 5)]), dated)
        nothing = F.lit(None).cast("string")
        return (F.when(line.rlike(UNIX_LINES + HEADER_ISO),
                       F.struct(iso(1).try_cast("timestamp").alias("ts"), iso(2).alias("host"),
                                iso(3).alias("program"), iso(4).alias("message")))
                .when(line.rlike(UNIX_LINES + HEADER_BSD),
                      F.struct(bsd_ts.alias("ts"), bsd(6).alias("host"), bsd(7).alias("program"),
                               bsd(9).alias("message")))
                .otherwise(F.struct(F.lit(None).cast("timestamp").alias("ts"), nothing.alias("host"),
                                    nothing.alias("program"), line.alias("message"))))
    return once(strip_pri(raw), read)


def program_host(raw: Column) -> tuple[Column, Column]:
    program = F.nullif(F.lower(F.regexp_extract(raw, PROGRAM_HOST, 2)), F.lit(""))
    return program, F.nullif(F.regexp_extract(raw, PROGRAM_HOST, 1), F.lit(""))


def classify_sql(parsers: tuple[Parser, ...] = DEFAULT_PARSERS) -> str:
    """Name of the first log type that claims the line, over ``raw`` and ``program``; null when none does."""
    return "CASE " + " ".join(f"WHEN {p.claims()} THEN '{p.name}'" for p in parsers) + " END"


def _held(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column that is worked out once per row.

    As the single item of an exploded array it stays a column of its own; as a
    plain column the optimizer would copy this very long expression into every
    filter and field that uses it.
    """
    return df.select("*", F.explode_outer(F.array(F.expr(expression))).alias(name))


def classify(envelopes: DataFrame, parsers: tuple[Parser, ...] = DEFAULT_PARSERS) -> DataFrame:
    """Add ``program`` and ``parser``."""
    program, _ = program_host(F.col("raw"))
    return _held(envelopes.withColumn("program", program), "parser", classify_sql(parsers))


def _number_sql(parser: Parser, index: int) -> str:
    """Number of the parser's first matching pattern."""
    base = (index + 1) * _PER_PARSER
    return "CASE " + " ".join(
        f"WHEN {p.found()} THEN {'NULL' if p.reject else base + i}"
        for i, p in enumerate(parser.patterns)) + " END"


def _by_pattern(parsers: tuple[Parser, ...], build) -> str:
    """SQL that picks ``build(parser, pattern, number)`` by pattern number, parser first."""
    outer = []
    for i, parser in enumerate(parsers):
        base = (i + 1) * _PER_PARSER
        inner = " ".join(f"WHEN {base + j} THEN {build(parser, q, base + j)}"
                         for j, q in enumerate(parser.patterns) if not q.reject)
        outer.append(f"WHEN {i} THEN CASE pattern_no {inner} END")
    return f"CASE cast(pattern_no DIV {_PER_PARSER} - 1 AS int) {' '.join(outer)} END"


def parse_logs(envelopes: DataFrame, parsers: tuple[Parser, ...] = DEFAULT_PARSERS,
               fallthrough: bool = False) -> DataFrame:
    """Envelopes plus ``parser``, ``reason`` (null when parsed) and ``parsed`` (flat event fields).

    With ``fallthrough`` a line whose first claimant cannot read it goes to the
    next one that claims it; otherwise it is set aside.
    """
    staged = classify(envelopes, parsers)
    if fallthrough:
        number = "coalesce(" + ", ".join(
            f"CASE WHEN {p.claims()} THEN {_number_sql(p, i)} END" for i, p in enumerate(parsers)) + ")"
    else:
        number = "CASE parser " + " ".join(
            f"WHEN '{p.name}' THEN {_number_sql(p, i)}" for i, p in enumerate(parsers)) + " END"
    # Running a long CASE under a lambda keeps it out of one generated method too large for the JIT.
    staged = _held(staged, "pattern_no", f"transform(array({number}), v -> coalesce(v, -1))[0]")
    # Groups that took no part read as ''.
    staged = _held(staged, "found", "transform(" + _by_pattern(parsers, lambda p, q, n: q.values(n)) + ", v -> coalesce(v, ''))")
    staged = _held(staged, "texts", "transform(" + _by_pattern(parsers, lambda p, q, n: q.event_texts(p)) + ", v -> nullif(v, ''))")
    staged = staged.withColumn("labels", F.expr(_by_pattern(parsers, lambda p, q, n: q.label_map())))
    hit = F.col("pattern_no") > 0
    staged = staged.withColumn("head", F.when(hit, header(F.col("raw"), F.col("received_at"))))
    owner = F.expr(f"cast(pattern_no DIV {_PER_PARSER} - 1 AS int)")

    def of_owner(attribute):
        return F.get(F.array(*[F.lit(getattr(p, attribute)) for p in parsers]), owner)

    def flat(name):
        return F.get(F.col("texts"), F.lit(TEXT_FIELDS.index(name)))

    def port(name):
        value = flat(name).try_cast("int")
        return F.when((value != 0) | of_owner("keep_zero_port"), value).alias(name)

    def size(name):
        return F.coalesce(flat(name).try_cast("long"), F.lit(0)).alias(name)

    parsed = F.struct(
        F.date_trunc("MILLISECOND", F.coalesce(F.col("head.ts"), F.col("received_at"), F.current_timestamp()))
        .alias("ts"),
        of_owner("dataset").alias("dataset"), of_owner("kind").alias("kind"),
        F.split(flat("category"), " ").alias("category"), flat("type").alias("type"),
        flat("severity").try_cast("int").alias("severity"), flat("outcome").alias("outcome"),
        F.when(flat("source_ip") == SENDER, F.col("source_ip")).otherwise(flat("source_ip")).alias("source_ip"),
        port("source_port"), flat("source_mac").alias("source_mac"), flat("dest_ip").alias("dest_ip"),
        port("dest_port"), flat("protocol").alias("protocol"),
        F.coalesce(flat("direction"), F.lit("unknown")).alias("direction"), size("bytes"), size("packets"),
        F.col("head.host").alias("hostname"), flat("user").alias("user"), of_owner("observer").alias("observer"),
        F.split(flat("tags"), " ").alias("tags"), F.col("labels"), flat("message").alias("message"))
    reason = F.when(F.col("parser").isNull(), "no_parser").when(~hit, "parse_failed")
    # Without fallthrough the claimant is the owner, and a filter by log type goes before the extraction.
    owner_name = F.when(hit, of_owner("name")).otherwise(F.col("parser")) if fallthrough else F.col("parser")
    return staged.select("id", "raw", "received_at", "source_ip", owner_name.alias("parser"),
                         reason.alias("reason"), F.when(hit, parsed).alias("parsed"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("id", "raw", "reason")


def derived_action(labels: Column, types: Column) -> Column:
    """Action name for rules that ask for one; the log types themselves never set it."""
    device = F.regexp_replace(F.try_element_at(labels, F.lit("device_action")), "^state_", "device.")
    return F.coalesce(
        F.try_element_at(labels, F.lit("wifi_action")), device, F.try_element_at(labels, F.lit("admin_action")),
        F.when(F.array_contains(types, "denied"), "denied").when(F.array_contains(types, "allowed"), "allowed"))


def to_ecs(parsed: DataFrame, compat: bool = True) -> DataFrame:
    """Nested events of the parsed rows, geo and threat still at their defaults."""
    p = F.col("parsed")
    types = F.array(p["type"])
    nothing = F.lit(None).cast("string")
    action = derived_action(p["labels"], types) if compat else nothing
    network_name = F.try_element_at(p["labels"], F.lit("ssid")) if compat else nothing
    return parsed.filter(F.col("reason").isNull()).select(
        p["ts"].alias("ts"),
        F.struct(F.col("id").alias("id"), p["kind"].alias("kind"), p["category"].alias("category"),
                 types.alias("type"), p["dataset"].alias("dataset"), p["severity"].alias("severity"),
                 p["outcome"].alias("outcome"), action.alias("action")).alias("event"),
        F.struct(p["source_ip"].alias("ip"), p["source_port"].alias("port"), p["source_mac"].alias("mac"),
                 F.lit(None).cast(GEO).alias("geo"), no_threat().alias("threat_intel")).alias("source"),
        F.struct(p["dest_ip"].alias("ip"), p["dest_port"].alias("port")).alias("destination"),
        F.struct(p["protocol"].alias("protocol"), p["direction"].alias("direction"), p["bytes"].alias("bytes"),
                 p["packets"].alias("packets"), network_name.alias("name")).alias("network"),
        F.struct(p["hostname"].alias("hostname"), F.array().cast("array<string>").alias("ip")).alias("host"),
        F.struct(p["user"].alias("name")).alias("user"),
        F.struct(p["observer"].alias("type"), F.lit(OBSERVER_NAME).alias("name"),
                 F.lit(OBSERVER_VENDOR).alias("vendor"), p["hostname"].alias("hostname"),
                 nothing.alias("mac_vendor")).alias("observer"),
        p["tags"].alias("tags"), p["labels"].alias("labels"), p["message"].alias("message"),
        F.col("raw").alias("raw_message"))


def no_threat() -> Column:
    return F.struct(F.lit(False).alias("matched"), F.lit(None).cast("string").alias("feed"),
                    F.lit(0).alias("score")).cast(THREAT)


def pipeline_counts(parsed: DataFrame) -> DataFrame:
    """Lines per log type and outcome, including those set aside."""
    status = (F.when(F.col("reason").isNull(), "success")
              .when(F.col("reason") == "parse_failed", "failed").otherwise("dead_letter"))
    dataset = F.coalesce(F.col("parsed.dataset"), F.concat(F.lit("unifi."), F.col("parser")), F.lit("unrecognized"))
    return parsed.groupBy(dataset.alias("dataset"), status.alias("status")).agg(F.count("*").alias("n"))


def observed_counts(parsed: DataFrame, parsers: tuple, observation: Observation) -> DataFrame:
    """``parsed``, whose lines per log type and outcome are noted in ``observation`` as it is read; no pass of its own."""
    reason, parser = F.col("reason"), F.col("parser")
    metrics = [F.count_if(reason == "no_parser").alias("unrecognized|dead_letter")]
    for p in parsers:
        metrics += [F.count_if(reason.isNull() & (parser == p.name)).alias(f"{p.dataset}|success"),
                    F.count_if((reason == "parse_failed") & (parser == p.name)).alias(f"unifi.{p.name}|failed")]
    return parsed.observe(observation, *metrics)


def counts_observed(observation: Observation) -> list[tuple[str, str, int]]:
    """(dataset, status, n) rows of ``observed_counts``, as ``pipeline_counts`` has them."""
    return [(*name.split("|"), n) for name, n in sorted(observation.get.items()) if n]


EVENT_COLUMNS = EVENT.fieldNames()
