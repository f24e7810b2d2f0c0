"""Reconstruction of weighted routes that explain a flow field.

The loop is on the driver, the data in tables: each round computes the residual, lets the
tasks search new basis paths for the representatives (the network is broadcast behind a
check of its size), builds the normal equations in one aggregation, solves the small dense
system, prunes, and writes the round's tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frechet as fr
from ..functions.graph import Net
from ..functions.solve import greedy_refine, min_cost_flow, nnls_batched, nnls_gram, nnls_incremental
from ..store import cut, ship
from . import field as fl
from .nets import collected
from .trajectory import to_arrays

FOUND = "traj_id string, edges array<long>, coef double"


@dataclass(frozen=True)
class Problem:
    """Network, field (e, value), representatives (traj_id, pos, x, y), and the distance."""

    edges: DataFrame
    vertices: DataFrame
    field: DataFrame
    representatives: DataFrame
    epsilon: float


@dataclass(frozen=True)
class Result:
    """basis (b, src_repr, pos, e), coefs (b, coef), the objective, and one row of log a step."""

    basis: DataFrame | None
    coefs: DataFrame | None
    objective: float
    log: list[dict] = field(default_factory=list)

    def size(self) -> int:
        return 0 if self.coefs is None else self.coefs.count()

    def top(self, n: int) -> Result:
        """Only the n largest coefficients."""
        coefs = cut(fl.top_weighted(self.coefs, n))
        return replace(self, coefs=coefs, basis=self.basis.join(coefs.select("b"), "b", "left_semi"))


@dataclass(frozen=True)
class Decomposer:
    """What one algorithm adds to the basis for a representative, given the residual."""

    iterations: int = 1
    prune: float = 1e-5

    #: True if all representatives are needed at once.
    joint = False
    #: True if a second round would find the same paths.
    once = True

    def paths(self, net: Net, line: np.ndarray, epsilon: float, residual: list[float]) -> list[tuple[list[int], float]]:
        raise NotImplementedError

    def all_paths(self, net: Net, lines: dict[str, np.ndarray], epsilon: float, residual: list[float]):
        raise NotImplementedError


def inside(net: Net, line: np.ndarray, epsilon: float) -> set[int]:
    """Vertices within epsilon of the line."""
    return set(fr.FreeSpace(net, line, epsilon).white)


def ends_of(net: Net, line: np.ndarray, epsilon: float) -> tuple[list[int], list[int]]:
    """Vertices in the disks around both ends of the line."""

    def disk(p) -> list[int]:
        return [v for v, (x, y) in sorted(net.xy.items()) if np.hypot(x - p[0], y - p[1]) <= epsilon]

    return disk(line[0]), disk(line[-1])


def overlay(net: Net, keep: set[int], sources: list[int], sinks: list[int]) -> tuple[Net, int, int]:
    """The subnetwork on ``keep`` with a super source and a super sink (negative edge ids)."""
    rows = [(i, a, b, 0.0) for i, (a, b) in enumerate(zip(net.src, net.dst, strict=True)) if a in keep and b in keep]
    s, t = -1, -2
    rows += [(-2 * k - 1, s, v, 0.0) for k, v in enumerate(sources) if v in keep]
    rows += [(-2 * k - 2, v, t, 0.0) for k, v in enumerate(sinks) if v in keep]
    return Net(rows), s, t


@dataclass(frozen=True)
class Trivial(Decomposer):
    """Every edge is a basis path of its own."""

    joint = True

    def all_paths(self, net, lines, epsilon, residual):
        return [("", [i], 0.0) for i in range(len(net.e))]


@dataclass(frozen=True)
class WidestPath(Decomposer):
    """Widest paths of the residual within each representative's buffer.

    After each, the mean of the path's residual (virtual edges count) is subtracted from it.
    """

    most: int = 50
    once = False

    def paths(self, net, line, epsilon, residual):
        keep = inside(net, line, epsilon)
        sources, sinks = ends_of(net, line, epsilon)
        sub, s, t = overlay(net, keep, sources, sinks)
        left, out = {i: residual[i] for i in sub.e if i >= 0}, []
        for _ in range(self.most):
            found = sub.widest(s, t, [left.get(e, np.inf) for e in sub.e])
            if found is None:
                break
            path = [sub.e[i] for i in found[1] if sub.e[i] >= 0]
            total = sum(left[i] for i in path)
            if total < 1e-7:
                break
            mean = total / len(found[1])
            for i in path:
                left[i] -= mean
            out.append((path, 0.0))
        return out


@dataclass(frozen=True)
class FrechetBand(Decomposer):
    """One path within epsilon of each representative."""

    def paths(self, net, line, epsilon, residual):
        path = fr.graph_path(net, line, epsilon)
        return [(path, 0.0)] if path else []


@dataclass(frozen=True)
class FrechetMatch(Decomposer):
    """The path of smallest Frechet distance to each representative."""

    lower: float = 5.0
    precision: float = 0.1

    def paths(self, net, line, epsilon, residual):
        found = fr.best_graph_path(net, line, self.lower, self.precision)
        return [(found[1], 0.0)] if found and found[1] else []


@dataclass(frozen=True)
class FrechetHitting(Decomposer):
    """For edges of the representative's buffer, by residual: a path within epsilon that takes the edge."""

    per_trajectory: int = 5
    extend_ends: bool = False
    once = False

    def paths(self, net, line, epsilon, residual):
        hit = fr.HittingPaths(net, line, epsilon)
        near = [i for i in range(len(net.e)) if net.src[i] in hit.space.white and net.dst[i] in hit.space.white]
        out, seen, covered = [], set(), set()
        for i in sorted(near, key=lambda i: (-residual[i], i)):
            if residual[i] < 0 or len(out) >= self.per_trajectory:
                break
            if i in covered:
                continue
            path = hit.through(i)
            if path is None or tuple(path) in seen:
                continue
            if self.extend_ends:
                path = extended(net, path, residual)
            seen.add(tuple(path))
            covered.update(path)
            out.append((path, 0.0))
        return out


def extended(net: Net, path: list[int], weight: list[float]) -> list[int]:
    """Edges are added at both ends as long as they raise the path's mean weight."""
    path, used = list(path), {net.src[path[0]], *(net.dst[i] for i in path)}
    for front in (True, False):
        while True:
            mean = sum(weight[i] for i in path) / len(path)
            ways = net.into.get(net.src[path[0]], ()) if front else net.out.get(net.dst[path[-1]], ())
            ways = [i for i in ways if (net.src[i] if front else net.dst[i]) not in used and weight[i] > mean]
            if not ways:
                break
            best = max(ways, key=lambda i: (weight[i], -i))
            used.add(net.src[best] if front else net.dst[best])
            path = [best, *path] if front else [*path, best]
    return path


@dataclass(frozen=True)
class WeightedFrechet(Decomposer):
    """A path within epsilon of each representative of large residual; bounded by expansions."""

    per_trajectory: int = 1
    most: int = 5000
    once = False

    def paths(self, net, line, epsilon, residual):
        left, out = list(residual), []
        for _ in range(self.per_trajectory):
            path = fr.weighted_path(net, line, epsilon, left, self.most)
            if not path or not fr.within(line, fr.path_points(net, path), epsilon + 1e-6):
                break
            out.append((path, 0.0))
            width = max(0.0, min(left[i] for i in path))
            for i in path:
                left[i] -= max(width, 1e-6)
        return out


def incidence(net: Net) -> tuple[np.ndarray, dict[int, int]]:
    place = {v: k for k, v in enumerate(net.vertices())}
    a = np.zeros((len(place), len(net.e)))
    for i in range(len(net.e)):
        a[place[net.src[i]], i] += 1
        a[place[net.dst[i]], i] -= 1
    return a, place


def flow_routes(net: Net, flow: np.ndarray, sources: set[int], sinks: set[int]) -> list[tuple[list[int], float]]:
    """Paths from sources to sinks, with cycles attached, that make up a flow."""
    out_flow = {v: sum(flow[i] for i in net.out.get(v, ())) - sum(flow[i] for i in net.into.get(v, ())) for v in sources | sinks}
    s, t = min(net.vertices()) - 1, min(net.vertices()) - 2
    rows = [(i, net.src[i], net.dst[i], 0.0) for i in range(len(net.e))]
    extra = {}
    for v, f in sorted(out_flow.items()):
        if abs(f) > 1e-8:
            number = -len(extra) - 1
            extra[number] = abs(f)
            rows.append((number, s, v, 0.0) if f > 0 else (number, v, t, 0.0))
    big = Net(rows)
    paths, cycles = big.decompose([extra[e] if e < 0 else float(flow[e]) for e in big.e], s, t, 1e-6)
    whole = big.attach_cycles(paths, cycles)
    return [([big.e[i] for i in p if big.e[i] >= 0], w) for p, w in whole]


@dataclass(frozen=True)
class GlobalMinCost(Decomposer):
    """The flow nearest to the field between the ends of all representatives, as routes."""

    joint = True

    def all_paths(self, net, lines, epsilon, residual):
        sources, sinks = set(), set()
        for line in lines.values():
            a, b = ends_of(net, line, epsilon)
            sources.update(a)
            sinks.update(b)
        a, place = incidence(net)
        free = np.zeros(len(place), bool)
        free[[place[v] for v in sources | sinks]] = True
        flow = min_cost_flow(a, free, np.array(residual))
        return [("", p, w) for p, w in flow_routes(net, flow, sources, sinks) if p]


@dataclass(frozen=True)
class MultiCommodity(Decomposer):
    """One flow for each representative in its own buffer; together they come nearest to the field."""

    rounds: int = 3
    joint = True

    def all_paths(self, net, lines, epsilon, residual):
        total = np.array(residual, float)
        parts = {}
        for name, line in sorted(lines.items()):
            keep = inside(net, line, epsilon)
            edges = [i for i in range(len(net.e)) if net.src[i] in keep and net.dst[i] in keep]
            if not edges:
                continue
            sub = Net([(k, net.src[i], net.dst[i], 0.0) for k, i in enumerate(edges)])
            a, place = incidence(sub)
            s, t = ends_of(net, line, epsilon)
            s, t = {v for v in s if v in place}, {v for v in t if v in place}
            free = np.zeros(len(place), bool)
            free[[place[v] for v in s | t]] = True
            parts[name] = [sub, np.array(edges), a, free, s, t, np.zeros(len(edges))]
        for _ in range(self.rounds):
            for part in parts.values():
                _, edges, a, free, _, _, flow = part
                total[edges] += flow
                part[6] = min_cost_flow(a, free, total[edges], 500)
                total[edges] -= part[6]
        out = []
        for name, (sub, edges, _, _, s, t, flow) in parts.items():
            out += [(name, [int(edges[i]) for i in p], w) for p, w in flow_routes(sub, flow, s, t) if p]
        return out


DECOMPOSERS = {
    "trivial": Trivial,
    "widest_path": WidestPath,
    "frechet_band": FrechetBand,
    "frechet": FrechetMatch,
    "frechet_hitting": FrechetHitting,
    "weighted_frechet": WeightedFrechet,
    "global_min_cost": GlobalMinCost,
    "multi_commodity": MultiCommodity,
}


def normal_equations(basis: DataFrame, flow_field: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Gram matrix and right side of the basis; its size is the basis' squared, not the field's."""
    a, rhs = fl.gram(basis, flow_field)
    names = sorted(r.b for r in basis.select("b").distinct().collect())
    place = {b: k for k, b in enumerate(names)}
    gram, right = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in a.collect():
        gram[place[r.b1], place[r.b2]] = gram[place[r.b2], place[r.b1]] = r.dot
    for r in rhs.collect():
        right[place[r.b]] = r.dot
    return names, gram, right


def fit(problem: Problem, basis: DataFrame, prune: float, mode: str = "full", batch: int = 50, retain: int | None = None, fraction: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(basis, coefs) after non-negative least squares and pruning.

    Modes: full, batched, incremental, greedy (steps from the full solution).
    """
    names, gram, right = normal_equations(basis, problem.field)
    if mode == "batched":
        c = nnls_batched(gram, right, batch)
    elif mode == "incremental":
        c = nnls_incremental(gram, right, batch, retain, fraction)
    else:
        c = nnls_gram(gram, right)
        c = greedy_refine(gram, right, c) if mode == "greedy" else c
    spark = basis.sparkSession
    coefs = cut(fl.prune(spark.createDataFrame(list(zip(names, map(float, c), strict=True)), "b long, coef double"), prune))
    return cut(basis.join(coefs.select("b"), "b", "left_semi")), coefs


def search(problem: Problem, algorithm: Decomposer, residual: DataFrame, first: int) -> DataFrame:
    """New basis rows (b, src_repr, pos, e), numbered from ``first`` in order of representative."""
    spark = problem.edges.sparkSession
    net = collected(problem.edges, problem.vertices)
    left = {r.e: r.value for r in residual.collect()}  # one number an edge of the broadcast network
    weight = [left.get(e, 0.0) for e in net.e]
    lines = to_arrays(problem.representatives)
    epsilon = problem.epsilon
    if algorithm.joint:
        held = {r.traj_id: np.array([(p.x, p.y) for p in r.pts]) for r in lines.collect()}
        rows = [(n, [net.e[i] for i in p], float(w)) for n, p, w in algorithm.all_paths(net, held, epsilon, weight)]
        found = spark.createDataFrame(rows, FOUND)
    else:
        shared = ship(spark, (net, weight))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            network, values = shared.value
            for b in batches:
                rows = []
                for name, pts in zip(b["traj_id"], b["pts"], strict=True):
                    line = np.array([(p["x"], p["y"]) for p in pts])
                    if len(line) > 1:
                        rows += [(name, [network.e[i] for i in p], w) for p, w in algorithm.paths(network, line, epsilon, values)]
                yield pd.DataFrame(rows, columns=["traj_id", "edges", "coef"])

        found = lines.repartition("traj_id").mapInPandas(run, FOUND)
    found = cut(found.where("size(edges) > 0").dropDuplicates(["edges"]))
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("traj_id", "edges")) + (first - 1)  # basis rows, few
    return found.select(number.cast("long").alias("b"), F.col("traj_id").alias("src_repr"), F.posexplode("edges").alias("pos", "e"))


def decompose(problem: Problem, algorithm: Decomposer, mode: str = "full") -> Result:
    """Rounds of search, fit and prune; ends early when a round adds nothing."""
    basis, coefs, log = None, None, []
    rest, first = problem.field, 0
    for k in range(algorithm.iterations):
        new = cut(search(problem, algorithm, rest, first))
        added = new.select("b").distinct().count()
        if not added:
            break
        first += added
        whole = new if basis is None else fl.extend_basis(basis, new)
        basis, coefs = fit(problem, whole, algorithm.prune, mode)
        rest = cut(fl.residual(problem.field, basis, coefs))
        value = fl.square_length(rest).first().objective
        log.append({"it": k, "step": "newbasis", "basisSize": coefs.count(), "objectiveValue": value})
        if algorithm.once:
            break
    return Result(basis, coefs, fl.square_length(rest).first().objective, log)
