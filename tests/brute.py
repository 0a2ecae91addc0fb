"""Single-process density clustering by definition, to compare with on small data."""

from __future__ import annotations

import numpy as np


def core_distances(x: np.ndarray, min_samples: int) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, min_samples - 1]


def reachability(x: np.ndarray, min_samples: int) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = core_distances(x, min_samples)
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def tree_weight(w: np.ndarray) -> float:
    """Total weight of a minimum spanning tree (Prim)."""
    best, done, total = w[0].copy(), {0}, 0.0
    while len(done) < len(w):
        best[list(done)] = np.inf
        v = int(best.argmin())
        total += best[v]
        done.add(v)
        best = np.minimum(best, w[v])
    return total


def _components(nodes: list[int], w: np.ndarray, below: float) -> list[list[int]]:
    left, out = set(nodes), []
    while left:
        stack, comp = [left.pop()], []
        while stack:
            v = stack.pop()
            comp.append(v)
            near = [u for u in left if w[v, u] < below]
            left.difference_update(near)
            stack += near
        out.append(sorted(comp))
    return out


def labels(x: np.ndarray, min_cluster_size: int, min_samples: int) -> list[frozenset[int]]:
    """Chosen clusters, from the top down: cut at each distance, follow the parts."""
    return labels_of(reachability(x, min_samples), min_cluster_size)


def path_maxima(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """For a tree, the heaviest edge between any two nodes."""
    w = np.zeros((n, n))
    inside = [{v} for v in range(n)]
    for a, b, d in sorted(edges, key=lambda e: e[2]):
        left, right = sorted(inside[a]), sorted(inside[b])
        w[np.ix_(left, right)] = d
        w[np.ix_(right, left)] = d
        both = inside[a] | inside[b]
        for v in both:
            inside[v] = both
    return w


def labels_of(w: np.ndarray, min_cluster_size: int) -> list[frozenset[int]]:
    floor = 1e-12

    def grow(nodes: list[int], birth: float | None) -> tuple[float, list[frozenset[int]]]:
        """(value, chosen clusters) of the cluster that starts as ``nodes``."""
        mass, members = 0.0, list(nodes)
        while True:
            # The heaviest edge that holds the members together is the next cut.
            cuts = _bottleneck(members, w)
            density = 1.0 / max(cuts, floor)
            parts = _components(members, w, cuts)
            large = [p for p in parts if len(p) >= min_cluster_size]
            small = sum(len(p) for p in parts if len(p) < min_cluster_size)
            mass += small * density
            if len(large) == 1:
                members = large[0]
                continue
            inner, chosen = 0.0, []
            for p in large:
                value, inside = grow(p, density)
                mass += len(p) * density
                inner += value
                chosen += inside
            if birth is None:
                return 0.0, chosen
            stability = mass - len(nodes) * birth
            return (stability, [frozenset(nodes)]) if stability >= inner else (inner, chosen)

    return grow(list(range(len(w))), None)[1]


def _bottleneck(members: list[int], w: np.ndarray) -> float:
    """Heaviest edge of a minimum spanning tree of ``members``."""
    sub = w[np.ix_(members, members)]
    best, done, worst = sub[0].copy(), np.zeros(len(members), bool), 0.0
    done[0] = True
    for _ in range(len(members) - 1):
        best[done] = np.inf
        v = int(best.argmin())
        worst = max(worst, best[v])
        done[v] = True
        best = np.where(done, np.inf, np.minimum(best, sub[v]))
    return worst
