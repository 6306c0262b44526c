"""Text, template and presentation expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import field, field_text

_PLACEHOLDER = re.compile(r"\{([^{}]+)\}")
# What a template shows for these fields when the event lacks them.
TEMPLATE_DEFAULTS = {"source.ip": "unknown", "destination.ip": "unknown", "host.name": "unknown"}
# Size units, 1024 steps.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# Meter level of each severity.
SEVERITY_LEVELS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def render(df: DataFrame, template: str, extra: dict[str, Column] | None = None) -> Column:
    """Fill ``{dotted.field}`` placeholders.

    A field missing from the schema keeps its placeholder, one that is null on
    the row becomes empty. The template is split while the plan is built, so
    each row only pays for one ``concat``.
    """
    extra = extra or {}
    parts: list[Column] = []
    position = 0
    for found in _PLACEHOLDER.finditer(template):
        if found.start() > position:
            parts.append(F.lit(template[position:found.start()]))
        name = found.group(1)
        if name in extra:
            parts.append(F.coalesce(extra[name].cast("string"), F.lit("")))
        elif name.endswith("_human") and field(df, name[:-6]) is not None:
            parts.append(format_bytes(field(df, name[:-6])))
        elif field(df, name) is not None:
            parts.append(F.coalesce(field_text(df, name), F.lit("")))
        else:
            parts.append(F.lit(TEMPLATE_DEFAULTS.get(name, found.group(0))))
        position = found.end()
    if position < len(template):
        parts.append(F.lit(template[position:]))
    return F.concat(*parts) if parts else F.lit("")


def format_bytes(n) -> Column:
    """``1536`` -> ``1.5 KB``: two decimals, trailing zeros cut."""
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    out = F.when(n >= 1, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.lit("0 B"))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        step = 1024 ** power
        shown = F.round(n.cast("decimal(20,0)") / F.lit(step).cast("decimal(20,0)"), 2).cast("string")
        out = F.when(n >= step, F.concat(F.regexp_replace(shown, r"\.?0+$", ""), F.lit(" " + unit))).otherwise(out)
    return F.when(n.isNotNull(), out)


def severity_level(severity) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(1)
    for name, level in SEVERITY_LEVELS.items():
        out = F.when(F.lower(severity) == name, level).otherwise(out)
    return out


def format_severity(severity) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.concat(F.upper(F.left(severity, F.lit(1))),
                    F.lower(F.substring(severity, 2, 2147483647)))


def tokens(text) -> Column:
    """Lower-case word list of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def any_term(text, terms: list[str]) -> Column:
    """True when the text holds at least one of the words. Reads the whole text."""
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*[F.lit(t) for t in terms])), F.lit(False))


def split_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", query.lower()) if t]


def metadata_json(metadata) -> Column:
    return F.to_json(F.col(metadata) if isinstance(metadata, str) else metadata)
