"""Cheapest edits of many short message lists at once, by the auction algorithm for shortest paths.

A list of n messages is a lattice of n + 1 layers with four nodes each: what the kept messages so far
end in. Arcs delete, keep or give another role to the next message, or insert one before it.
Every arc cost is an integer, and every cycle costs something, as the algorithm needs.
"""
from __future__ import annotations

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
FINE, MUST_GO, TRUNCATED = range(3)
LABELS = "DIKR"
DELETE, INSERT, REROLE, TRUNCATION = 2, 5, 1, 5
CLOSED = 1 << 40
# End costs of a whole list: nothing kept, or ended by an assistant.
WHOLE = (0, CLOSED, CLOSED, 0)

# Node after a message of the role that may follow, and after a message kept as it is (by first letter: s, u, a, other).
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])


class Lattices:
    """Lists padded to one length: ``kind``, ``letter`` (0 to 3) and ``times`` of each message, ``length`` of each
    list, and ``ends``: what is left to pay after the list, by node."""

    def __init__(self, lists: list[list[tuple[int, int, int]]], ends: np.ndarray):
        self.length = np.array([len(x) for x in lists], np.int64)
        width = int(self.length.max()) if len(lists) else 0
        full = np.zeros((3, len(lists), width + 1), np.int64)
        for k, own in enumerate(lists):
            if own:
                full[:, k, : len(own)] = np.array(own, np.int64).T
        self.kind, self.letter, self.times = full
        self.ends = ends
        least = np.where(self.kind == MUST_GO, DELETE * self.times, np.where(self.kind == TRUNCATED, DELETE, 0))
        least[np.arange(width + 1) >= self.length[:, None]] = 0
        # Prices of nodes: no more than what is left to pay, as each message costs its own least at least.
        after = np.cumsum(least[:, ::-1], axis=1)[:, ::-1] + ends.min(axis=1)[:, None]
        self.prices = np.repeat(after[:, :, None], 4, axis=2)

    def arcs(self, own: np.ndarray, layer: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs, next layers and next nodes of the arcs D, I, K, R and the end, for one node of each list in ``own``."""
        inside = layer < self.length[own]
        kind, letter = self.kind[own, layer], self.letter[own, layer]
        extra = np.where(kind == TRUNCATED, TRUNCATION, 0)
        stays = inside & (kind != MUST_GO)
        kept, after = _KEPT[node, letter], _NEXT[node]
        cost = np.stack([np.where(inside, DELETE * self.times[own, layer], CLOSED), np.full(len(own), INSERT),
                         np.where(stays & (kept >= 0), extra, CLOSED), np.where(stays, REROLE + extra, CLOSED),
                         np.where(inside, CLOSED, self.ends[own, node])], axis=1)
        ahead = np.minimum(layer + 1, self.length[own])
        return cost, np.stack([ahead, layer, ahead, ahead], axis=1), np.stack([node, after, np.maximum(kept, 0), after], axis=1)

    def bids(self, own: np.ndarray, layer: np.ndarray, node: np.ndarray):
        """Cost of each arc plus the price of where it leads, and where that is."""
        cost, to_layer, to_node = self.arcs(own, layer, node)
        cost[:, :4] += self.prices[own[:, None], to_layer, to_node]
        return cost, to_layer, to_node

    def run(self, start: np.ndarray) -> np.ndarray:
        """Least total cost from node ``start`` of each list's first layer; ``prices`` are then dual prices that prove it.

        One path per list grows from its start. Where the price of its last node is below the best bid, the
        price rises to it and the path loses that node; otherwise the path takes the arc of the best bid.
        All lists take their steps side by side.
        """
        count, width = self.prices.shape[:2]
        path = np.zeros((2, count, 4 * width + 1), np.int32)
        path[1, :, 0] = start
        depth = np.zeros(count, np.int64)
        own = np.arange(count)
        while len(own):
            at = depth[own]
            layer, node = path[0, own, at], path[1, own, at]
            bid, to_layer, to_node = self.bids(own, layer, node)
            best = bid.argmin(axis=1)
            least = bid[np.arange(len(own)), best]
            rises = self.prices[own, layer, node] < least
            self.prices[own[rises], layer[rises], node[rises]] = least[rises]
            depth[own[rises]] = np.maximum(at[rises] - 1, 0)
            grows = ~rises & (best < 4)
            arc, more = best[grows], own[grows]
            depth[more] += 1
            path[0, more, depth[more]] = to_layer[grows, arc]
            path[1, more, depth[more]] = to_node[grows, arc]
            own = own[rises | grows]
        return self.prices[np.arange(count), 0, start]

    def open_nodes(self) -> np.ndarray:
        """Nodes from which arcs without slack lead to the end: they alone are on cheapest paths."""
        count, width = self.prices.shape[:2]
        found = np.zeros((count, width, 4), bool)
        every = np.arange(count)
        for k in range(width - 1, -1, -1):
            layer = np.minimum(k, self.length)
            own = every[k <= self.length]
            for arcs in ((0, 2, 3, 4), (1,), (1,)):
                for node in range(4):
                    bid, to_layer, to_node = self.bids(own, layer[own], np.full(len(own), node))
                    for arc in arcs:
                        tight = bid[:, arc] == self.prices[own, k, node]
                        found[own, k, node] |= tight if arc == 4 else tight & found[own, to_layer[:, arc], to_node[:, arc]]
        return found

    def trace(self, start: np.ndarray) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """Of the cheapest paths from ``start`` the one whose labels come first in ASCII order: (cost, last node, steps).

        A step is (arc, message, node it leads to). ``run`` must have settled the prices.
        """
        open_ = self.open_nodes()
        count = len(start)
        layer, node = np.zeros(count, np.int64), np.array(start, np.int64)
        costs = np.zeros(count, np.int64)
        steps: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
        own = np.arange(count)
        while len(own):
            bid, to_layer, to_node = self.bids(own, layer[own], node[own])
            tight = bid == self.prices[own, layer[own], node[own]][:, None]
            tight[:, :4] &= open_[own[:, None], to_layer, to_node]
            # At the end of a list stopping comes first: what may be inserted there belongs to what follows.
            tight[tight[:, 4], :4] = False
            arc = tight.argmax(axis=1)
            cost = self.arcs(own, layer[own], node[own])[0][np.arange(len(own)), arc]
            goes = arc < 4
            for k, a, i, q in zip(own[goes].tolist(), arc[goes].tolist(), layer[own[goes]].tolist(), to_node[goes, arc[goes]].tolist()):
                steps[k].append((a, i, q))
            more = own[goes]
            costs[more] += cost[goes]
            layer[more], node[more] = to_layer[goes, arc[goes]], to_node[goes, arc[goes]]
            own = more
        return list(zip(costs.tolist(), node.tolist(), steps))


def reachable(start: int, end: int, letters: list[tuple[int, int, int]]) -> bool:
    """Whether a list leads from one node to another: inserting leads to the last two, only a kept system message to the second."""
    if end in (USER, ASSISTANT) or start == end:
        return True
    return start == START and end == SYSTEM and any(kind != MUST_GO and letter == 0 for kind, letter, _ in letters)


def distances(lists: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """For each list the least cost between each node before it and each node after it, ``CLOSED`` where there is no path."""
    out = np.full((len(lists), 4, 4), CLOSED, np.int64)
    asked = [(k, i, j) for k, own in enumerate(lists) for i in range(4) for j in range(4) if reachable(i, j, own)]
    ends = np.full((len(asked), 4), CLOSED, np.int64)
    for row, (_, _, j) in enumerate(asked):
        ends[row, j] = 0
    if asked:
        found = Lattices([lists[k] for k, _, _ in asked], ends).run(np.array([i for _, i, _ in asked]))
        for (k, i, j), cost in zip(asked, found.tolist()):
            out[k, i, j] = cost
    return out
