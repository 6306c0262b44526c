"""Small numpy helpers for one time chunk of one key. Spark does the grouping.

A chunk's rows are in time order; the first ``first`` rows are copied from the
chunk before. A detector fires when enough is seen within the window since its
last firing, so all the past a chunk needs is where the last firing was. Each
helper therefore takes that as ``entry`` and returns the firings.
"""
from __future__ import annotations

import numpy as np

NONE = "none"


def window_starts(ts: np.ndarray, window_ms: int) -> np.ndarray:
    """Index of the first row inside (ts - window, ts] for every row."""
    return np.searchsorted(ts, ts - window_ms, side="right")


class CountChunk:
    """Fires on the n-th event in the window. ``entry``: events since the last firing, or NONE."""

    def __init__(self, ts, counts, first, n, window_ms, chunk_end):
        self.ts, self.n, self.window_ms, self.chunk_end = ts, n, window_ms, chunk_end
        self.ends = np.cumsum(counts)
        begins = self.ends - counts
        self.before = int(begins[first]) if first < len(ts) else int(self.ends[-1]) if len(ts) else 0
        reach = begins[window_starts(ts, window_ms)] + n if len(ts) else begins
        # Events lo..hi of each time can fire, counting events from 1.
        lo = np.maximum(begins + 1, reach)
        usable = np.flatnonzero((lo <= self.ends) & (np.arange(len(ts)) >= first))
        self.rows, self.lo, self.hi = usable, lo[usable], self.ends[usable]
        self.total = int(self.ends[-1]) if len(ts) else 0

    def can_fire(self) -> bool:
        return len(self.rows) > 0

    def entries(self) -> list[str]:
        return [NONE] + [str(r) for r in range(self.n - 1)]

    def fire(self, entry: str):
        """(row, firings at that time) pairs, and the entry of the next chunk."""
        last = -self.n if entry == NONE else self.before - int(entry)
        fired, at = [], 0
        while True:
            at = max(at, int(np.searchsorted(self.hi, last + self.n, side="left")))
            if at >= len(self.rows):
                break
            position = max(int(self.lo[at]), last + self.n)
            times = 1 + (int(self.hi[at]) - position) // self.n
            fired.append((int(self.rows[at]), times))
            last = position + (times - 1) * self.n
        left = self.total - last
        if not fired or left >= self.n - 1 or self.ts[fired[-1][0]] <= self.chunk_end - self.window_ms:
            return fired, NONE
        return fired, str(left)


class DistinctChunk:
    """Fires on the n-th distinct item in the window. ``entry``: time and item of the last firing, or NONE."""

    def __init__(self, ts, items, counts, first, n, window_ms, chunk_start, chunk_end):
        self.ts, self.items, self.counts, self.n = ts, items, counts, n
        self.first, self.window_ms, self.chunk_end = first, window_ms, chunk_end
        size = len(ts)
        self.begin = window_starts(ts, window_ms) if window_ms else np.zeros(size, dtype=np.int64)
        # span[j]: latest start from which n distinct items are seen by row j, -1 if none.
        self.span, self.previous = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        seen: dict = {}
        last_at: dict = {}
        left = 0
        for j, item in enumerate(items):
            self.previous[j] = last_at.get(item, -1)
            last_at[item] = j
            seen[item] = seen.get(item, 0) + 1
            while len(seen) > n or (len(seen) == n and seen[items[left]] > 1):
                if seen[items[left]] == 1:
                    del seen[items[left]]
                else:
                    seen[items[left]] -= 1
                left += 1
            if len(seen) == n:
                self.span[j] = left
        candidate = (self.span >= 0) & (self.begin <= self.span)
        self.candidate = candidate
        index = np.where(candidate, np.arange(size), size)
        self.next_candidate = np.append(np.minimum.accumulate(index[::-1])[::-1], size)
        self.open_start = int(np.searchsorted(ts, chunk_start - window_ms, side="right")) if window_ms else 0

    def can_fire(self) -> bool:
        return bool(self.candidate[self.first:].any())

    def _start_after(self, row: int) -> int:
        # A second equal event at the same time belongs to the new window.
        return row if self.counts[row] > 1 else row + 1

    def _next(self, start: int, floor: int = 0) -> int:
        return int(self.next_candidate[max(int(np.searchsorted(self.span, start, side="left")), floor)])

    def _label(self, row: int) -> str:
        return f"{self.ts[row]}|{self.items[row]}"

    def entries(self) -> list[str]:
        """Every place before this chunk that may hold the last firing; about n of them."""
        before = np.arange(self.open_start, self.first)
        able = before[self.candidate[before] & (self.previous[before] < self.span[before])]
        return [NONE, *(self._label(r) for r in able if self._next(self._start_after(r)) >= self.first)]

    def fire(self, entry: str):
        """(row, items in the window by last sight) pairs, and the entry of the next chunk."""
        start = self.open_start
        if entry != NONE:
            when, item = entry.split("|", 1)
            low, high = np.searchsorted(self.ts[:self.first], [int(when), int(when) + 1])
            start = self._start_after(next(r for r in range(low, high) if self.items[r] == item))
        fired = []
        row = self._next(start, self.first)
        while row < len(self.ts):
            low = max(start, int(self.begin[row]))
            latest = {}
            for r in range(low, row + 1):
                latest.pop(self.items[r], None)
                latest[self.items[r]] = (int(self.ts[r]), self.items[r])
            fired.append((row, [item for _, item in sorted(latest.values())]))
            start = self._start_after(row)
            row = self._next(start, self.first)
        if not fired or self.ts[fired[-1][0]] <= self.chunk_end - self.window_ms:
            return fired, NONE
        return fired, self._label(fired[-1][0])
