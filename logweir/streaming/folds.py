"""Stateful folds over a key's rows in event-time order, for ``transformWithState``.

Rows wait in a list state until the watermark passes them and are then taken in order of time and
tie, so a replay gives what the batch operators give, whatever order rows arrived in within the
allowed delay. What a fold remembers is typed state of its own: one entry per millisecond, item,
marker or country, of which only changed entries are written. Timers wake a key for its next waiting
row, and once more when nothing it remembers can matter any longer.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

COUNT_MARK = "\x01count\x01"


def _plain(value):
    """Nested rows as tuples, which state can hold."""
    if isinstance(value, (tuple, list)):
        return list(map(_plain, value)) if isinstance(value, list) else tuple(map(_plain, value))
    return value


class Fold:
    """What a key remembers and what it makes of each row. One object serves all keys of a task, one at a time."""

    # Name, key type and value type of each map the fold remembers.
    maps: tuple[tuple[str, str, str], ...] = ()
    output: str = ""

    def begin(self, memory: dict[str, dict], key: tuple) -> None:
        """Called before the ready rows of a key, also when there are none."""

    def take(self, memory: dict[str, dict], row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def prune(self, memory: dict[str, dict], mark: int) -> int | None:
        """Forget what no row after ``mark`` needs; the time at which the rest can go, None for never or nothing left."""
        return None


class InOrder(StatefulProcessor):
    """Feeds a fold. Input rows have ts_ms, ts_us and tie; ``waiting`` are the fields that are kept of them. Output rows begin with the key."""

    def __init__(self, fold: Fold, waiting: StructType, output: list[str]):
        self.fold, self._type, self._names, self._output = fold, waiting, waiting.fieldNames(), output

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._type)
        self._maps = {name: handle.getMapState(name, f"k {key}", value) for name, key, value in self.fold.maps}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = [tuple(_plain(r[name]) for name in self._names) for r in rows]
        self._waiting.appendList(arrived)
        first = self._names.index("ts_ms")
        self._handle.registerTimer(min(r[first] for r in arrived))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [Row(*self._names)(*r) for r in self._waiting.get()] if self._waiting.exists() else []
        ready = sorted((r for r in waiting if r.ts_ms <= mark), key=lambda r: (r.ts_ms, r.tie))
        rest = [r for r in waiting if r.ts_ms > mark]
        memory = {name: {k[0]: tuple(v) for k, v in state.iterator()} for name, state in self._maps.items()}
        stored = {name: dict(entries) for name, entries in memory.items()}
        out = []
        self.fold.begin(memory, tuple(key))
        for row in ready:
            out += [Row(**dict(zip(self._output, (*key, *fired)))) for fired in self.fold.take(memory, row)]
        ends = self.fold.prune(memory, mark)
        for name, state in self._maps.items():
            for k in stored[name].keys() - memory[name].keys():
                state.removeKey((k,))
            for k, v in memory[name].items():
                if stored[name].get(k) != v:
                    state.updateValue((k,), v)
        if len(rest) < len(waiting):
            self._waiting.put([_plain(tuple(r)) for r in rest]) if rest else self._waiting.clear()
        if rest:
            self._handle.registerTimer(min(r.ts_ms for r in rest))
        elif ends is not None:
            self._handle.registerTimer(max(ends, mark + 1))
        return iter(out)

    def close(self) -> None:
        pass


class _Window:
    """Rows per millisecond within a window, counted as time goes on."""

    def __init__(self, ticks: dict[int, tuple]):
        self.ticks = ticks
        self.order = deque(sorted(ticks))
        self.total = sum(n for (n,) in ticks.values())

    def add(self, t: int, window_ms: int) -> int:
        while self.order and self.order[0] <= t - window_ms:
            self.total -= self.ticks.pop(self.order.popleft())[0]
        if not self.order or self.order[-1] != t:
            self.order.append(t)
            self.ticks[t] = (0,)
        self.ticks[t] = (self.ticks[t][0] + 1,)
        self.total += 1
        return self.total

    def clear(self) -> None:
        self.ticks.clear()
        self.order.clear()
        self.total = 0


class CountFold(Fold):
    """Fires on the n-th row within the window and starts over. (ts_ms, nth): firings of one time are numbered."""

    maps = (("ticks", "long", "n long"),)
    output = "ts_ms long, nth long"

    def __init__(self, n: int, window_ms: int):
        self.n, self.window_ms = n, window_ms

    def begin(self, memory, key):
        self.window, self.fired = _Window(memory["ticks"]), (None, 0)

    def take(self, memory, row):
        if self.window.add(row.ts_ms, self.window_ms) >= self.n:
            self.window.clear()
            self.fired = (row.ts_ms, self.fired[1] + 1 if self.fired[0] == row.ts_ms else 1)
            yield self.fired

    def prune(self, memory, mark):
        for t in [t for t in memory["ticks"] if t <= mark - self.window_ms]:
            del memory["ticks"][t]
        return max(memory["ticks"]) + self.window_ms if memory["ticks"] else None


class SlidingFold(Fold):
    """Rows within (ts - window, ts] for every row: (ts_ms, id, count)."""

    maps = CountFold.maps
    output = "ts_ms long, id string, count long"

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def begin(self, memory, key):
        self.window = _Window(memory["ticks"])

    def take(self, memory, row):
        yield row.ts_ms, row.tie, self.window.add(row.ts_ms, self.window_ms)

    prune = CountFold.prune


class DistinctFold(Fold):
    """Fires on the n-th distinct item within the window, or within a fixed bucket, and starts over: (ts_ms, item, items).

    items are those of the window by last sight, the first ``stored`` of them, or all. The item of a row is its tie.
    """

    maps = (("items", "string", "ts_ms long"),)
    output = "ts_ms long, item string, items array<string>"

    def __init__(self, n: int, window_ms: int | None, bucket_ms: int | None = None, stored: int | None = None):
        self.n, self.window_ms, self.bucket_ms, self.stored = n, window_ms, bucket_ms, stored

    def _gone(self, seen_ms: int, t: int) -> bool:
        return seen_ms // self.bucket_ms != t // self.bucket_ms if self.bucket_ms else seen_ms <= t - self.window_ms

    def take(self, memory, row):
        items, t = memory["items"], row.ts_ms
        for item in [k for k, (seen,) in items.items() if self._gone(seen, t)]:
            del items[item]
        items[row.tie] = (t,)
        if len(items) >= self.n:
            order = [item for _, item in sorted((seen, item) for item, (seen,) in items.items())]
            items.clear()
            yield t, row.tie, order[:self.stored]

    def prune(self, memory, mark):
        for item in [k for k, (seen,) in memory["items"].items() if self._gone(seen, mark + 1)]:
            del memory["items"][item]
        length = self.bucket_ms or self.window_ms
        return max(seen for (seen,) in memory["items"].values()) + length if memory["items"] else None


class FirstFold(Fold):
    """The first row of a key, once and for all: (ts_us, id, what)."""

    maps = (("seen", "boolean", "ts_ms long"),)

    def __init__(self, what: StructType):
        self.names, self.output = what.fieldNames(), f"ts_us long, id string, what {what.simpleString()}"

    def take(self, memory, row):
        if not memory["seen"]:
            memory["seen"][True] = (row.ts_ms,)
            yield row.ts_us, row.tie, dict(zip(self.names, row.what))


class NewItemFold(Fold):
    """The first row of each item but the key's first one, with the items known before: (item, ts_us, id, what, known)."""

    maps = (("known", "string", "ts_ms long"),)

    def __init__(self, what: StructType):
        self.names = what.fieldNames()
        self.output = f"item string, ts_us long, id string, what {what.simpleString()}, known array<string>"

    def take(self, memory, row):
        known = memory["known"]
        if row.item not in known:
            if known:
                yield row.item, row.ts_us, row.tie, dict(zip(self.names, row.what)), sorted(known)
            known[row.item] = (row.ts_ms,)


class _Markers:
    """Dedup keys and the throttle of a group: a marker set at t ends at t + its time, and hits do not extend it."""

    maps = (("live", "string", "ends long"), ("free", "boolean", "at long"))

    @staticmethod
    def disposition(memory: dict[str, dict], t: int, dedup_key: str, dedup_ms: int, throttle_ms: int) -> str:
        if memory["live"].get(dedup_key, (t,))[0] > t:
            return "deduplicated"
        memory["live"][dedup_key] = (t + dedup_ms,)
        if memory["free"].get(True, (t,))[0] > t:
            return "throttled"
        memory["free"][True] = (t + throttle_ms,)
        return "emitted"

    @staticmethod
    def prune(memory: dict[str, dict], mark: int) -> int | None:
        for name in ("live", "free"):
            for k in [k for k, (ends,) in memory[name].items() if ends <= mark]:
                del memory[name][k]
        ends = [e for name in ("live", "free") for (e,) in memory[name].values()]
        return max(ends) if ends else None


class SuppressFold(Fold):
    """What becomes of each candidate: (id, disposition)."""

    maps = _Markers.maps
    output = "id string, disposition string"

    def take(self, memory, row):
        yield row.tie, _Markers.disposition(memory, row.ts_ms, row.dedup_key, row.dedup_ms, row.throttle_ms)

    def prune(self, memory, mark):
        return _Markers.prune(memory, mark)


class RuleFold(Fold):
    """Rows of one rule and group: those at the threshold of the sliding count are candidates, suppressed as above.

    Emits the time (us) and the fields of the row's ``alert`` with the count written into its texts.
    """

    maps = (*CountFold.maps, *_Markers.maps)
    texts = ("title", "description")

    def __init__(self, windows_ms: list[int], alert: StructType):
        """The window of each rule, by the number that a key begins with, and the type of ``alert``."""
        self.windows_ms, self.names = windows_ms, alert.fieldNames()
        self.output = ", ".join(["ts_us long", *(f"{f.name} {f.dataType.simpleString()}" for f in alert)])

    def begin(self, memory, key):
        self.window, self.window_ms = _Window(memory["ticks"]), self.windows_ms[key[0]]

    def take(self, memory, row):
        count = self.window.add(row.ts_ms, self.window_ms)
        if count < row.threshold:
            return

        def filled(text):
            return None if text is None else text.replace(COUNT_MARK, str(count))
        if _Markers.disposition(memory, row.ts_ms, filled(row.dedup_key), row.dedup_ms, row.throttle_ms) == "emitted":
            values = {**dict(zip(self.names, row.alert)), "event_count": count}
            yield row.ts_us, *(filled(v) if name in self.texts else v for name, v in values.items())

    def prune(self, memory, mark):
        ends = [CountFold.prune(self, memory, mark), _Markers.prune(memory, mark)]
        return max((e for e in ends if e is not None), default=None)
