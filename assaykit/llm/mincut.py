"""Minimum cut of small labelling graphs by augmenting paths, after fixing the nodes no neighbour can turn."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

_EPS = 1e-9


@lru_cache(maxsize=200_000)
def _component(costs: tuple[float, ...], edges: tuple[tuple[int, int, float], ...]) -> tuple[bool, ...]:
    """Max-flow on one component; True for the source (content) side. Ties go to the source side."""
    n = len(costs)
    source, sink = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, c in enumerate(costs):
        if c > 0:
            cap[source][i] = c
            cap[i].setdefault(source, 0.0)
        else:
            cap[i][sink] = -c
            cap[sink].setdefault(i, 0.0)
    for a, b, w in edges:
        cap[a][b] = cap[a].get(b, 0.0) + w
        cap[b][a] = cap[b].get(a, 0.0) + w
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > _EPS and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            break
        flow, v = float("inf"), sink
        while v != source:
            flow = min(flow, cap[parent[v]][v])
            v = parent[v]
        v = sink
        while v != source:
            cap[parent[v]][v] -= flow
            cap[v][parent[v]] = cap[v].get(parent[v], 0.0) + flow
            v = parent[v]
    # What cannot reach the sink any more is content, so a tie keeps the line.
    back: dict[int, list[int]] = {}
    for u in range(n + 2):
        for v, c in cap[u].items():
            if c > _EPS:
                back.setdefault(v, []).append(u)
    lost = {sink}
    queue = deque([sink])
    while queue:
        for u in back.get(queue.popleft(), ()):
            if u not in lost:
                lost.add(u)
                queue.append(u)
    return tuple(i not in lost for i in range(n))


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost: a node pays |cost| for the label against its sign, an edge its weight if cut.

    Nodes whose own cost is at least the weight of all their open edges keep their sign in some minimum cut; they are
    fixed and folded into their neighbours, again and again. What is left falls into small components for the max-flow.
    """
    n = len(costs)
    pull = [0.0] * n
    for a, b, w in edges:
        pull[a] += w
        pull[b] += w
    if all(abs(c) >= w for c, w in zip(costs, pull)):
        return [c >= 0 for c in costs]
    own = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(own[i]) < sum(near[i].values()) - _EPS:
            continue
        label[i] = own[i] >= 0
        sign = 1.0 if label[i] else -1.0
        for j, w in near[i].items():
            own[j] += sign * w
            del near[j][i]
            if label[j] is None:
                todo.append(j)
        near[i] = {}
    seen: set[int] = set()
    for i in range(n):
        if label[i] is not None or i in seen:
            continue
        comp, queue = [], [i]
        seen.add(i)
        while queue:
            u = queue.pop()
            comp.append(u)
            for v in near[u]:
                if v not in seen:
                    seen.add(v)
                    queue.append(v)
        comp.sort()
        at = {u: k for k, u in enumerate(comp)}
        inner = tuple((at[u], at[v], round(w, 6)) for u in comp for v, w in sorted(near[u].items()) if u < v)
        for u, side in zip(comp, _component(tuple(round(own[u], 6) for u in comp), inner)):
            label[u] = side
    return [bool(x) for x in label]


def cut_cost(costs: list[float], edges: list[tuple[int, int, float]], labels: list[bool]) -> float:
    """Total cost of a labelling; what ``min_cut`` makes least."""
    return sum(abs(c) for c, x in zip(costs, labels) if (c > 0) != x and c) + sum(w for a, b, w in edges if labels[a] != labels[b])
