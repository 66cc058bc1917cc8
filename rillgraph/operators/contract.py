"""Greedy contraction of one block's graph: the cheapest edges first, up to a threshold or the first edge that leaves the block.

Contraction is sequential within a block, so it runs as a kernel on the block's edges; everything between blocks is relational.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pyarrow as pa

from rillgraph.functions.policies import MERGERS, POLICIES, py_hist_median


@dataclass
class _Edge:
    a: int
    b: int
    affinity: float
    multiplicity: int
    hist: list[int] | None
    weight: float = 0.0
    stale: bool = False
    alive: bool = True


@dataclass
class Block:
    """A block's graph. ``ghosts`` maps nodes that other blocks own to those blocks."""

    policy: str
    counts: dict[int, int]
    ghosts: dict[int, int]
    edges: list[_Edge] = field(default_factory=list)
    at: dict[int, dict[int, int]] = field(default_factory=dict)
    merges: list[tuple[int, int, int, float]] = field(default_factory=list)

    def _weigh(self, e: _Edge) -> float:
        p = POLICIES[self.policy]
        median = py_hist_median(e.hist, 0.0, 1.0 / p.bins) if p.bins else 0.0
        return p.py_weight(e.affinity, self.counts[e.a], self.counts[e.b], median)

    def _fold(self, into: _Edge, other: _Edge) -> None:
        into.affinity = MERGERS[POLICIES[self.policy].merger][1](into.affinity, into.multiplicity, other.affinity, other.multiplicity)
        into.multiplicity += other.multiplicity
        if into.hist is not None:
            into.hist = [x + y for x, y in zip(into.hist, other.hist)]

    def add(self, a: int, b: int, affinity: float, multiplicity: int, hist: list[int] | None = None, weight: float | None = None) -> int:
        """A new edge, merged with the one between the same nodes if there is one."""
        if (old := self.at.get(a, {}).get(b)) is not None:
            self._fold(self.edges[old], _Edge(a, b, affinity, multiplicity, hist))
            self.edges[old].weight = self._weigh(self.edges[old])
            return old
        e, i = _Edge(a, b, affinity, multiplicity, hist), len(self.edges)
        e.weight = self._weigh(e) if weight is None else weight
        self.edges.append(e)
        self.at.setdefault(a, {})[b] = i
        self.at.setdefault(b, {})[a] = i
        return i

    def contract(self, i: int, node: int) -> list[int]:
        """Join the ends of edge ``i`` to ``node``, one of them. Of two edges that become parallel the lighter one takes
        up the other; edges of the joined node become stale. Returns those that are left."""
        e = self.edges[i]
        gone = e.b if node == e.a else e.a
        e.alive = False
        del self.at[e.a][e.b], self.at[e.b][e.a]
        for other, j in sorted(self.at.pop(gone, {}).items()):
            del self.at[other][gone]
            if (k := self.at[node].get(other)) is None:
                keep = j
            else:
                one, two = self.edges[k], self.edges[j]
                keep, drop = (k, j) if (one.weight, k) <= (two.weight, j) else (j, k)
                self._fold(self.edges[keep], self.edges[drop])
                self.edges[drop].alive = False
            self.at[node][other] = self.at[other][node] = keep
            left = self.edges[keep]
            left.a, left.b = min(node, other), max(node, other)
        for j in self.at[node].values():
            self.edges[j].stale = True
        return list(self.at[node].values())

    def run(self, threshold: float, region_ratio: float = 0.0) -> int | None:
        """Contract; the block that owns the far end of the first edge that leaves this one, if one was met."""
        internal = len(self.counts) - len(self.ghosts)
        heap = [(e.weight, e.a, e.b, i) for i, e in enumerate(self.edges)]
        heapq.heapify(heap)
        target = None
        while heap and (len(self.merges) < internal * region_ratio or target is None):
            w, _, _, i = heapq.heappop(heap)
            e = self.edges[i]
            if not e.alive:
                continue
            if e.stale:
                e.stale, e.weight = False, self._weigh(e)
                heapq.heappush(heap, (e.weight, e.a, e.b, i))
                continue
            if w > threshold:
                break
            owner = self.ghosts.get(e.a, self.ghosts.get(e.b))
            if owner is not None:
                target = owner if target is None else target
                continue
            a, b = e.a, e.b
            node = min(a, b)
            self.merges.append((a, b, node, w))
            self.counts[node] = self.counts[a] + self.counts[b]
            self.contract(i, node)
        return target

    def roots(self) -> dict[int, int]:
        """Where the nodes that went have ended up. The smaller node of a merge stays, so a root is its component's least node."""
        found = {}
        for a, b, node, _ in reversed(self.merges):
            found[max(a, b)] = found.get(node, node)
        return found


RESULT = "block long, kind string, seq int, n1 long, n2 long, n long, weight double, target long"


def kernel(policy: str, threshold: float, region_ratio: float = 0.0):
    """For ``groupBy('block').applyInArrow``: rows (block, src, dst, affinity, multiplicity, hist, bs, bd, cs, cd) to merges and pointers."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = rows[0]["block"]
        rows.sort(key=lambda r: (r["src"], r["dst"]))
        counts, ghosts = {}, {}
        for r in rows:
            for node, block, cnt in ((r["src"], r["bs"], r["cs"]), (r["dst"], r["bd"], r["cd"])):
                counts[node] = cnt
                if block != own:
                    ghosts[node] = block
        g = Block(policy, counts, ghosts)
        for r in rows:
            g.add(r["src"], r["dst"], r["affinity"], r["multiplicity"], r["hist"])
        target = g.run(threshold, region_ratio)
        out = [(own, "merge", i, *m, None) for i, m in enumerate(g.merges)]
        out += [(own, "root", 0, gone, root, None, None, None) for gone, root in g.roots().items()]
        out += [(own, "point", 0, None, None, None, None, target)] if target is not None else []
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run
