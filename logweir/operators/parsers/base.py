"""How a log type is described: ordered patterns, and the event fields each one fills.

A pattern names its regex groups; event fields are templates over those names
(``"{ip}"``, ``"from {ip|?}"`` with a default for an empty group). ``derive``
adds further named texts computed from the groups by SQL expressions. Labels
whose name ends in ``?`` are left out when empty.

Expressions are built as SQL text and handed to Spark in a few ``expr`` calls;
building some ten thousand Column objects one by one takes far longer than
the job itself on a small batch.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

UNIX_LINES = "(?d)"
# Order of the texts a pattern hands on.
TEXT_FIELDS = ("source_ip", "source_mac", "dest_ip", "protocol", "direction", "user", "outcome", "type",
               "source_port", "dest_port", "bytes", "packets", "severity", "message", "tags", "category")

Getter = Callable[[str], str]
Derived = Callable[[Getter], str]
_SLOT = re.compile(r"\{(\w+)(?:\|([^{}]*))?\}")


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extract(regex: str, group: int) -> str:
    return f"regexp_extract(raw, {text(UNIX_LINES + regex)}, {group})"


def like(regex: str, subject: str = "raw") -> str:
    return f"({subject} RLIKE {text(UNIX_LINES + regex)})"


# Patterns a log type may have; they are numbered within a range of this size.
MOST_PATTERNS = 9_999


@dataclass(frozen=True)
class Pattern:
    regex: str
    groups: str = ""
    message: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    severity: int | str | None = None
    derive: dict[str, Derived] = field(default_factory=dict)
    also: str = ""
    reject: bool = False

    @property
    def names(self) -> list[str]:
        return self.groups.split() + list(self.derive)

    def found(self) -> str:
        hit = like(self.regex)
        return f"({hit} AND {self.also})" if self.also else hit

    def values(self, number: int) -> str:
        """Array of the pattern's number and its named texts."""
        group_names = self.groups.split()

        def get(name: str) -> str:
            if name in group_names:
                return extract(self.regex, group_names.index(name) + 1)
            return self.derive[name](get)

        return "array(" + ", ".join([f"'{number}'"] + [get(n) for n in self.names]) + ")"

    def _fill(self, template: str) -> str:
        parts, at = [], 0
        for slot in _SLOT.finditer(template):
            if slot.start() > at:
                parts.append(text(template[at:slot.start()]))
            value = f"found[{self.names.index(slot.group(1)) + 1}]"
            if slot.group(2) is not None:
                value = f"coalesce(nullif({value}, ''), {text(slot.group(2))})"
            parts.append(value)
            at = slot.end()
        if at < len(template):
            parts.append(text(template[at:]))
        return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")" if parts else "''"

    def event_texts(self, parser: "Parser") -> str:
        """Array of the event's fields in the order of TEXT_FIELDS."""
        spec = {**parser.defaults, **self.fields, "message": self.message,
                "severity": str(parser.severity if self.severity is None else self.severity),
                "tags": self.fields.get("tags", parser.tags),
                "category": self.fields.get("category", parser.category)}
        return "array(" + ", ".join(self._fill(spec.get(name, "")) for name in TEXT_FIELDS) + ")"

    def label_map(self) -> str:
        if not self.labels:
            return "cast(map() AS map<string, string>)"
        built = "map(" + ", ".join(f"{text(n.rstrip('?'))}, {self._fill(t)}" for n, t in self.labels.items()) + ")"
        optional = ", ".join(text(n.rstrip("?")) for n in self.labels if n.endswith("?"))
        return f"map_filter({built}, (k, v) -> v != '' OR k NOT IN ({optional}))" if optional else built


@dataclass(frozen=True)
class Parser:
    name: str
    dataset: str
    keywords: str
    patterns: tuple[Pattern, ...]
    category: str
    programs: tuple[str, ...] = ()
    # "any": program or keyword; "keyword": keyword alone; "both": program and keyword.
    claim: str = "keyword"
    kind: str = "event"
    severity: int = 5
    observer: str = "firewall"
    tags: str = ""
    defaults: dict[str, str] = field(default_factory=dict)
    keep_zero_port: bool = False
    # SQL condition over ``raw`` and ``program`` that replaces the keyword test.
    predicate: str = ""

    def claims(self) -> str:
        """SQL condition, never null: does this log type take the line?"""
        if self.predicate:
            return f"coalesce(({self.predicate}), false)"
        keyword = like(self.keywords)
        if self.claim == "keyword":
            return keyword
        named = "coalesce(program IN (" + ", ".join(text(p) for p in self.programs) + "), false)"
        return f"({named} {'OR' if self.claim == 'any' else 'AND'} {keyword})"


def lower(name: str) -> Derived:
    return lambda get: f"lower({get(name)})"


def upper(name: str) -> Derived:
    return lambda get: f"upper({get(name)})"


def strip(name: str) -> Derived:
    return lambda get: f"trim({get(name)})"


def cut(name: str, size: int) -> Derived:
    return lambda get: f"left({get(name)}, {size})"


def first_group(regex: str, group: int = 1) -> Derived:
    """Another pattern searched in the same line."""
    return lambda get: extract(regex, group)


def phrase(name: str, before: str, after: str = "") -> Derived:
    """``before + value + after``, or nothing when the value is empty."""
    return lambda get: (f"CASE WHEN {get(name)} = '' THEN '' "
                        f"ELSE concat({text(before)}, {get(name)}, {text(after)}) END")


def choose(test: Derived, yes: str, no: str) -> Derived:
    return lambda get: f"CASE WHEN {test(get)} THEN {text(yes)} ELSE {text(no)} END"


def one_of(name: str, *values: str, case=str.lower) -> Derived:
    """Condition: the value, case folded, is one of ``values``."""
    listed = ", ".join(text(case(v)) for v in values)
    return lambda get: f"{case.__name__}({get(name)}) IN ({listed})"
