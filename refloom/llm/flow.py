"""Min-cost flow on a small graph, by successive shortest paths with potentials."""

from __future__ import annotations

import heapq


class Flow:
    """Directed graph with integer capacities and non-negative costs."""

    def __init__(self, n: int) -> None:
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> tuple[int, int]:
        """Greatest flow from s to t and its least cost."""
        flow = total = 0
        pot = [0] * self.n
        while True:
            dist, via = [None] * self.n, [-1] * self.n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] and (dist[v] is None or d + self.cost[e] + pot[u] - pot[v] < dist[v]):
                        dist[v] = d + self.cost[e] + pot[u] - pot[v]
                        via[v] = e
                        heapq.heappush(heap, (dist[v], v))
            if dist[t] is None:
                return flow, total
            for v in range(self.n):
                if dist[v] is not None:
                    pot[v] += dist[v]
            push, v = None, t
            while v != s:
                e = via[v]
                push = self.cap[e] if push is None else min(push, self.cap[e])
                v = self.to[e ^ 1]
            v = t
            while v != s:
                e = via[v]
                self.cap[e] -= push
                self.cap[e ^ 1] += push
                v = self.to[e ^ 1]
            flow += push
            total += push * (pot[t] - pot[s])

    def used(self, e: int) -> int:
        return self.cap[e ^ 1]


def route(capacity: dict[frozenset[str], int], quota: dict[str, int], repeats: dict[str, int]) -> tuple[dict[tuple[frozenset[str], str], int], int]:
    """Tokens that each membership pattern gives to each source, and the total routed.

    A pattern's tokens may be used again at a cost that grows with every use; a source takes no more
    than its quota, and no pattern more often than the source may repeat.
    """
    patterns, sources = sorted(capacity, key=sorted), sorted(quota)
    g = Flow(2 + len(patterns) + len(sources))
    at = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    edges = {}
    for k, p in enumerate(patterns):
        mine = [s for s in sorted(p) if s in at and repeats[s] > 0]
        for use in range(sum(repeats[s] for s in mine)):
            g.edge(0, 2 + k, capacity[p], use * use)
        for s in mine:
            edges[(p, s)] = g.edge(2 + k, at[s], capacity[p] * repeats[s])
    for s in sources:
        g.edge(at[s], 1, quota[s])
    flow, _ = g.run(0, 1)
    return {k: g.used(e) for k, e in edges.items() if g.used(e)}, flow


def greatest_total(capacity: dict[frozenset[str], int], share: dict[str, float], repeats: dict[str, int]) -> int:
    """Greatest total size for which every source can fill its share."""
    low, high = 0, sum(c * max((repeats[s] for s in p if s in repeats), default=0) * len(p) for p, c in capacity.items()) + 1
    while low < high:
        mid = (low + high + 1) // 2
        quota = {s: int(v * mid) for s, v in share.items()}
        if route(capacity, quota, repeats)[1] == sum(quota.values()):
            low = mid
        else:
            high = mid - 1
    return low
