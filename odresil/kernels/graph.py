"""Communities of a small graph by modularity, NumPy only: one start after another, each in a random order of its own."""

from __future__ import annotations

import numpy as np


def modularity(a: np.ndarray, label: np.ndarray, gamma: float) -> float:
    """Share of weight within groups less gamma times what the degrees alone would put there; 0 for a graph without edges."""
    total = a.sum()
    if total <= 0:
        return 0.0
    same = label[:, None] == label
    degree = a.sum(1)
    return float((a[same].sum() - gamma * np.outer(degree, degree)[same].sum() / total) / total)


def _settled(graph: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """Groups after moving nodes, in random order, to the group of largest gain until none moves."""
    n = len(graph)
    group, degree, total = np.arange(n), graph.sum(1), graph.sum()
    member = np.eye(n)  # [node, group]
    calm = 0
    while calm < n:
        for i in rng.permutation(n):
            old = group[i]
            member[i, old] = 0
            links = graph[i] @ member - graph[i, i] * member[i]
            gain = links - gamma * degree[i] * (degree @ member) / total
            best = int(gain.argmax())
            if gain[best] <= gain[old] + 1e-12:
                best = old
            member[i, best], group[i] = 1, best
            calm = calm + 1 if best == old else 0
            if calm >= n:
                break
    return group


def louvain(a: np.ndarray, gamma: float, seed: int) -> np.ndarray:
    """Labels in order of first members: local moves, groups become nodes, until no group joins another."""
    rng = np.random.default_rng(seed)
    a = np.asarray(a, float)
    owner, graph = np.arange(len(a)), a
    while a.sum() > 0:
        kinds, group = np.unique(_settled(graph, gamma, rng), return_inverse=True)
        owner = group[owner]
        if len(kinds) == len(graph):
            break
        fold = np.eye(len(kinds))[group]
        graph = fold.T @ graph @ fold
    return np.unique(owner, return_index=True)[1].argsort().argsort()[np.unique(owner, return_inverse=True)[1]]
