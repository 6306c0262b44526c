"""Spans of code points found in texts, and what queries report of them."""
from __future__ import annotations

import hashlib

Span = tuple[int, int, str]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(span: tuple[int, int], others: list[Span]) -> bool:
    return all(span[1] <= start or end <= span[0] for start, end, _ in others)
