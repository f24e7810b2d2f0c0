"""Small dense solvers in numpy: non-negative least squares, flow projection, set cover."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np


def nnls_gram(gram: np.ndarray, rhs: np.ndarray, start: np.ndarray | None = None, sweeps: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """min |A c - f|^2 with c >= 0 from the normal equations (A'A, A'f), by coordinate descent.

    Ends when no coordinate moves by more than the tolerance (relative to the largest),
    which is the Karush-Kuhn-Tucker point of this convex problem.
    """
    c = np.zeros(len(rhs)) if start is None else start.astype(float).copy()
    diag = np.diag(gram)
    grad = gram @ c - rhs
    use = np.flatnonzero(diag > 0)
    for _ in range(sweeps):
        moved = 0.0
        for k in use:
            new = max(0.0, c[k] - grad[k] / diag[k])
            step = new - c[k]
            if step:
                grad += gram[:, k] * step
                c[k] = new
                moved = max(moved, abs(step))
        if moved <= tolerance * max(1.0, np.abs(c).max(initial=0)):
            break
    return c


def nnls_batched(gram: np.ndarray, rhs: np.ndarray, batch: int) -> np.ndarray:
    """Adds ``batch`` columns at a time and starts from what it has; the answer is that of one go."""
    c = np.zeros(0)
    for n in range(batch, len(rhs) + batch, batch):
        n = min(n, len(rhs))
        c = nnls_gram(gram[:n, :n], rhs[:n], np.concatenate([c, np.zeros(n - len(c))]))
        if n == len(rhs):
            break
    return c


def nnls_incremental(gram: np.ndarray, rhs: np.ndarray, batch: int, retain: int | None = None, fraction: float | None = None) -> np.ndarray:
    """Solves what is retained with the next batch, and keeps the largest coefficients.

    ``fraction`` grows the number retained with every batch up to that share of all columns.
    """
    c, kept = np.zeros(len(rhs)), np.zeros(0, np.int64)
    batches = -(-len(rhs) // batch)
    for k in range(batches):
        now = np.concatenate([kept, np.arange(k * batch, min((k + 1) * batch, len(rhs)))]).astype(np.int64)
        part = nnls_gram(gram[np.ix_(now, now)], rhs[now])
        most = retain if fraction is None else int(np.ceil(fraction * len(rhs) * (k + 1) / batches))
        order = np.lexsort((now, -part))[: len(now) if k == batches - 1 or most is None else most]
        kept = np.sort(now[order])
        c[:] = 0
        c[now] = part
        drop = np.setdiff1d(now, kept)
        c[drop] = 0
    return c


def greedy_refine(gram: np.ndarray, rhs: np.ndarray, c: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Coordinate steps from a given solution; a step that would turn a coefficient negative is skipped."""
    c = c.astype(float).copy()
    grad = gram @ c - rhs
    for _ in range(sweeps):
        moved = False
        for k in range(len(c)):
            if gram[k, k] > 0:
                step = -grad[k] / gram[k, k]
                if abs(step) > 1e-12 and c[k] + step >= 0:
                    c[k] += step
                    grad += gram[:, k] * step
                    moved = True
        if not moved:
            break
    return c


def objective(gram: np.ndarray, rhs: np.ndarray, square: float, c: np.ndarray) -> float:
    return float(c @ gram @ c - 2 * rhs @ c + square)


def min_cost_flow(incidence: np.ndarray, free: np.ndarray, target: np.ndarray, rounds: int = 2000, tolerance: float = 1e-7) -> np.ndarray:
    """min |x - target|^2 with x >= 0 and conservation at the vertices that are not ``free``.

    Dykstra's alternating projections between the conservation subspace and the positive
    cone, which converge to the projection onto their intersection.
    """
    a = incidence[~free]
    inner = np.linalg.pinv(a @ a.T) if len(a) else np.zeros((0, 0))
    x, p, q = target.astype(float).copy(), np.zeros(len(target)), np.zeros(len(target))
    for _ in range(rounds):
        y = x + p
        y = y - a.T @ (inner @ (a @ y)) if len(a) else y
        p = x + p - y
        z = np.maximum(y + q, 0)
        q = y + q - z
        if np.abs(z - x).max(initial=0) < tolerance and np.abs(y - z).max(initial=0) < tolerance:
            x = z
            break
        x = z
    return x


def set_cover(sets: dict, universe: set, exact_most: int = 24) -> list | None:
    """Keys of sets that cover the universe: as few as possible for up to ``exact_most`` useful
    sets, else a greedy choice (an upper bound); None if some element has no set."""
    sets = {k: set(v) & universe for k, v in sets.items()}
    if set().union(*sets.values()) != universe:
        return None
    having: dict = defaultdict(list)
    for k, v in sets.items():
        for x in v:
            having[x].append(k)

    def spare(k, v: set) -> bool:  # a set that holds v holds its rarest element
        return any((v < sets[j]) or (v == sets[j] and j < k) for j in min((having[x] for x in v), key=len) if j != k)

    useful = {k: v for k, v in sets.items() if v and not spare(k, v)}
    left, greedy, heap = set(universe), [], [(-len(v), k) for k, v in useful.items()]
    heapq.heapify(heap)
    while left:  # gains only fall: a set whose gain is still the one in the heap is best
        gain, k = heapq.heappop(heap)
        now = len(useful[k] & left)
        if now == -gain:
            greedy.append(k)
            left -= useful[k]
        elif now:
            heapq.heappush(heap, (-now, k))
    best = sorted(greedy)
    if len(useful) > exact_most:
        return best

    def search(left: set, chosen: list) -> None:
        nonlocal best
        if not left:
            if len(chosen) < len(best):
                best = sorted(chosen)
            return
        widest = max(len(v & left) for v in useful.values())
        if len(chosen) + -(-len(left) // widest) >= len(best):
            return
        hard = min(left, key=lambda x: (sum(x in v for v in useful.values()), x))
        for k in sorted((k for k, v in useful.items() if hard in v), key=lambda k: (-len(useful[k] & left), k)):
            search(left - useful[k], [*chosen, k])

    search(set(universe), [])
    return best
