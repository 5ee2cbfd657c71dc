"""Small exact solvers that SQL can't express, on numpy: assignment, union-find, shortest paths, hull volume, peaks."""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of n nodes, numbered from 0 in the order of each component's smallest node."""
    root, a, b = np.arange(n), np.asarray(a, np.int64), np.asarray(b, np.int64)
    while len(a):
        # Each root takes the least root that an edge of its tree leads to; then every node points at its root.
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([low, low]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return np.unique(root, return_inverse=True)[1].reshape(-1).astype(np.int64)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of all rows or all columns (whichever are fewer), by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        least = np.full(m + 1, np.inf)
        back = np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while owner[j0]:
            done[j0] = True
            row = owner[j0]
            free = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row - 1, free - 1] - u[row] - v[free]
            better = reduced < least[free]
            least[free[better]] = reduced[better]
            back[free[better]] = j0
            j1 = free[least[free].argmin()]
            step = least[j1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def match_or_leave(pairs: np.ndarray, cost: np.ndarray, alone: float) -> dict[int, int]:
    """Right -> left of the pairing of least cost, where a left node without a partner costs ``alone``. ``pairs``: (n, 2) of left and right nodes.

    The graph of pairs is split into components first; each is solved by itself, so no part of it can change another, not even by its ties. A component
    of one left or one right node is a minimum; the others grow their pairing by one left node after the other along the cheapest alternating path.
    """
    if not len(pairs):
        return {}
    if len(pairs) <= FEW:
        return match_few(sorted(zip(*np.transpose(pairs).tolist(), np.asarray(cost, float).tolist(), strict=True)), alone)
    left, right = (np.unique(x, return_inverse=True) for x in pairs.T)
    part = union_find(len(left[0]) + len(right[0]), left[1], right[1] + len(left[0]))[left[1]]
    order = np.lexsort((pairs[:, 1], pairs[:, 0], part))
    out: dict[int, int] = {}
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        out |= _matched([(int(i), int(j), float(c)) for (i, j), c in zip(pairs[rows], cost[rows], strict=True)], alone)
    return out


#: Pairs that are matched without arrays, which cost more than so few.
FEW = 64


def match_few(pairs: list[tuple[int, int, float]], alone: float) -> dict[int, int]:
    """``match_or_leave`` of a few pairs (left, right, cost) in order, without arrays."""
    of_left: dict[int, list] = {}
    of_right: dict[int, list] = {}
    for e in pairs:
        a, b = of_left.get(e[0]), of_right.get(e[1])
        if a is None:
            a = of_left[e[0]] = [] if b is None else b
        if b is None:
            b = of_right[e[1]] = a
        a.append(e)
        if a is not b:  # two components become one
            a += b
            of_left |= {i: a for i, _, _ in b}
            of_right |= {j: a for _, j, _ in b} | {e[1]: a}
    out: dict[int, int] = {}
    for block in {id(x): x for x in of_left.values()}.values():
        out |= _matched(sorted(block), alone)
    return out


def _matched(block: list[tuple[int, int, float]], alone: float) -> dict[int, int]:
    """The pairing of one component."""
    if len(block) == 1 or len({i for i, _, _ in block}) == 1 or len({j for _, j, _ in block}) == 1:
        i, j, c = min(block, key=lambda e: (e[2], e[0], e[1]))
        return {j: i} if c < alone else {}
    return _grown(block, alone)


def _grown(block: list[tuple[int, int, float]], alone: float) -> dict[int, int]:
    edges: dict[int, dict[int, float]] = {}
    for i, j, c in block:
        edges.setdefault(i, {})[j] = c
    owner: dict[int, int] = {}
    mate: dict[int, int | None] = {}
    for start in sorted(edges):
        # Costs of reaching left nodes by giving up what they have, and right nodes; a path ends at a free right node, or at a left node that stays alone.
        reach, via, came = {start: 0.0}, {start: None}, {}
        best, end = alone, (start, None)
        waiting = [start]
        for i in waiting:
            if reach[i] + alone < best:
                best, end = reach[i] + alone, (i, None)
            for j, c in edges[i].items():
                if j == mate.get(i) or (d := reach[i] + c) >= came.get(j, (np.inf,))[0] - 1e-12:
                    continue
                came[j] = (d, i)
                k = owner.get(j)
                if k is None:
                    if d < best:
                        best, end = d, (None, j)
                elif d - edges[k][j] < reach.get(k, np.inf) - 1e-12:
                    reach[k], via[k] = d - edges[k][j], j
                    waiting.append(k)
        i, j = end
        while True:
            if j is not None:
                i = came[j][1]
                owner[j] = i
            mate[i], j = j, mate.get(i)  # what it had goes to the node before it on the path
            if i == start:
                break
    return owner


def shortest_from(n: int, edges: list[tuple[int, int, float]], sources: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every node to its nearest source and that source (-1 if none), ties to the source listed first."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    dist, own = np.full(n, np.inf), np.full(n, -1)
    heap = [(0.0, k, s) for k, s in enumerate(sources)]
    while heap:
        d, k, x = heapq.heappop(heap)
        if own[x] >= 0:
            continue
        dist[x], own[x] = d, sources[k]
        for y, w in near[x]:
            if own[y] < 0:
                heapq.heappush(heap, (d + w, k, y))
    return dist, own


def convex_cut_volumes(half_spaces: np.ndarray) -> np.ndarray:
    """Volume of {p : n·p <= c} for each of many polytopes, (pairs, planes, 4) with rows (n, c): vertices of plane triples, then pyramids over faces."""
    n, c = half_spaces[:, :, :3], half_spaces[:, :, 3]
    i, j, k = (np.array(t) for t in zip(*combinations(range(n.shape[1]), 3), strict=True))
    with np.errstate(all="ignore"):
        # Cramer's rule on all triples of all pairs at once.
        jk, ki, ij = np.cross(n[:, j], n[:, k]), np.cross(n[:, k], n[:, i]), np.cross(n[:, i], n[:, j])
        det = (n[:, i] * jk).sum(2)
        v = (c[:, i, None] * jk + c[:, j, None] * ki + c[:, k, None] * ij) / det[:, :, None]
        off = v @ n.transpose(0, 2, 1) - c[:, None, :]
        corner = (np.abs(det) > 1e-9) & (off <= 1e-9).all(2)
    v = np.where(corner[:, :, None], v, 0.0)
    mid = v.sum(1) / np.maximum(corner.sum(1), 1)[:, None]
    volume = np.zeros(len(n))
    for f in range(n.shape[1]):
        size = np.linalg.norm(n[:, f], axis=1)
        # A plane that another row gives as well bounds the polytope once.
        again = ((np.abs(n[:, :f] - n[:, f, None]) < 1e-9).all(2) & (np.abs(c[:, :f] - c[:, f, None]) < 1e-9)).any(1)
        on = corner & (np.abs(off[:, :, f]) < 1e-7)
        some = np.flatnonzero((on.sum(1) >= 3) & ~again)
        if not len(some):
            continue
        on, unit = on[some], n[some, f] / size[some, None]
        at = np.where(on[:, :, None], v[some] - ((v[some] * on[:, :, None]).sum(1) / on.sum(1)[:, None])[:, None], 0.0)
        # Around the face's middle, in its plane; what isn't of the face goes last and is its first corner again.
        x = np.eye(3)[np.abs(unit).argmin(1)]
        x = np.cross(unit, x)
        x /= np.linalg.norm(x, axis=1)[:, None]
        p, q = (at @ x[:, :, None])[:, :, 0], (at @ np.cross(unit, x)[:, :, None])[:, :, 0]
        order = np.where(on, np.arctan2(q, p), np.inf).argsort(1)
        p, q, on = (np.take_along_axis(y, order, 1) for y in (p, q, on))
        p, q = np.where(on, p, p[:, :1]), np.where(on, q, q[:, :1])
        area = np.abs((p * np.roll(q, -1, 1) - q * np.roll(p, -1, 1)).sum(1)) / 2
        volume[some] += area * np.abs((c[some, f] / size[some]) - (mid[some] * unit).sum(1)) / 3
    return volume


def boxes_half_spaces(centre: np.ndarray, size: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(boxes, 6, 4) of centres (boxes, 3), sizes (boxes, 3) and rotations (boxes, 3, 3)."""
    axes = rotation.transpose(0, 2, 1)
    at = (axes @ centre[:, :, None])[:, :, 0]
    return np.concatenate([np.concatenate([s * axes, (s * at + size / 2)[:, :, None]], 2) for s in (1.0, -1.0)], 1)


def oriented_ious(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Intersection over union of pairs of oriented boxes (centres, sizes, rotations)."""
    inter = convex_cut_volumes(np.concatenate([boxes_half_spaces(*a), boxes_half_spaces(*b)], 1))
    union = a[1].prod(1) + b[1].prod(1) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def oriented_iou(a: tuple, b: tuple) -> float:
    """Intersection over union of two oriented boxes (centre, size, rotation)."""
    return float(oriented_ious(*(tuple(np.asarray(v, float)[None] for v in box) for box in (a, b)))[0])


def peaks(y: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Local maxima (middles of plateaus) of at least this prominence, highest first kept within ``distance``."""
    found, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-y[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def stands_out(p: int) -> float:
        left = p
        while left >= 0 and y[left] <= y[p]:
            left -= 1
        right = p
        while right < n and y[right] <= y[p]:
            right += 1
        return y[p] - max(y[left + 1 : p + 1].min(), y[p:right].min())

    return np.array(sorted(p for p in kept if stands_out(p) >= prominence), int)


def mean_rotation(quaternions: np.ndarray) -> np.ndarray:
    """The unit quaternion that is the leading eigenvector of the summed outer products."""
    q = np.asarray(quaternions, float)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    vec = np.linalg.eigh(q.T @ q)[1][:, -1]
    return vec if vec[np.abs(vec).argmax()] > 0 else -vec
