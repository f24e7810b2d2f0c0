"""Map matching: candidates and emissions in SQL, Viterbi and routing in a grouped kernel."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frechet as fr
from ..functions.geometry import nearest_on_segment
from ..functions.graph import INF, Net
from .nets import broadcast_net
from .spatial import nearest_edges
from .trajectory import to_arrays


def candidates(points: DataFrame, lines: DataFrame, k: int = 8, radius: float = 300.0, gps_error: float = 50.0) -> DataFrame:
    """(traj_id, pos, t, px, py, e, rank, dist, offset, emission): the k nearest edges of each point.

    ``lines`` are edges with their ends (e, x1, y1, x2, y2).
    """
    p = points.select("traj_id", "pos", F.col("x").alias("px"), F.col("y").alias("py"))
    d = nearest_edges(p, lines, ["traj_id", "pos"], k, radius)
    _, _, along = nearest_on_segment(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")))
    chance = F.exp(F.lit(-0.5) * F.col("dist") * F.col("dist") / (gps_error * gps_error))
    return d.select("traj_id", "pos", "px", "py", "e", "rank", "dist", along.alias("offset"), chance.alias("emission"))


def transition(straight: float, route: float) -> float:
    """How well a route's length agrees with the straight step: the smaller over the larger."""
    return (route + 1e-12) / (straight + 1e-12) if straight >= route else straight / route


#: Ways that a matcher remembers.
WAYS = 100_000


class Matcher:
    """Matches one line after the other; the searches of the earlier ones serve the later."""

    def __init__(self, net: Net, speed_bound: float):
        self.net, self.speed, self.known, self.ways = net, speed_bound, {}, {}

    def way(self, source: int, sink: int) -> list[int] | None:
        """Edges of a shortest way; None if there is none."""
        if (source, sink) not in self.ways:
            if len(self.ways) > WAYS:
                self.ways.clear()
            found = self.net.shortest(source, sink)
            self.ways[source, sink] = None if found is None else found[1]
        return self.ways[source, sink]

    def route(self, source: int, sink: int, bound: float) -> float | None:
        """Shortest length below ``bound``, from a table of one search a source."""
        limit, dist = self.known.get(source, (-1.0, {}))
        if limit < bound:
            dist, _ = self.net.distances(source, bound)
            if len(self.known) > 2000:
                self.known.clear()
            self.known[source] = (bound, dist)
        d = dist.get(sink)
        return d if d is not None and d < bound else None

    def step(self, a: tuple, b: tuple, straight: float, seconds: float) -> float | None:
        """Transition of candidate a = (edge, offset) to b."""
        if a[0] == b[0] and b[1] >= a[1]:
            return transition(straight, b[1] - a[1])
        net = self.net
        way = self.route(net.dst[a[0]], net.src[b[0]], self.speed * seconds if math.isfinite(self.speed) else INF)
        return None if way is None else transition(straight, b[1] + net.length[a[0]] - a[1] + way)

    def pieces(self, layers: list[list[tuple]], places: list[tuple]) -> tuple[int, list[tuple]]:
        """The longest connected run of best candidates: (first layer, candidates).

        The score of a candidate adds transition times emission along the way; of equal
        ways the last wins; the first layer starts at 0.  A layer that cannot be reached
        starts afresh.  A run of one layer is no match.
        """
        best, back = [[0.0] * len(layers[0])] if layers else [], [[-1] * len(layers[0])] if layers else []
        for k in range(1, len(layers)):
            (x0, y0, t0), (x1, y1, t1) = places[k - 1], places[k]
            straight, seconds = math.hypot(x1 - x0, y1 - y0), t1 - t0
            score, pred = [], []
            for e, off, chance in layers[k]:
                top, via = -1.0, -1
                for j, (e0, off0, _) in enumerate(layers[k - 1]):
                    p = self.step((e0, off0), (e, off), straight, seconds)
                    if p is not None and best[k - 1][j] + p * chance >= top:
                        top, via = best[k - 1][j] + p * chance, j
                score.append(top if via >= 0 else 0.0)
                pred.append(via)
            if all(v < 0 for v in pred):
                score = [0.0] * len(score)
            elif any(v < 0 for v in pred):  # candidates without a way cannot be chosen over others
                score = [s if v >= 0 else -1.0 for s, v in zip(score, pred, strict=True)]
            best.append(score)
            back.append(pred)
        runs, k = [], len(layers) - 1
        while k >= 0:
            if not layers[k]:
                k -= 1
                continue
            i = max(range(len(best[k])), key=lambda i: (best[k][i], i))
            run = [layers[k][i]]
            while back[k][i] >= 0:
                i = back[k][i]
                k -= 1
                run.append(layers[k][i])
            runs.append((k, run[::-1]))
            k -= 1
        longest = max(runs, key=lambda r: (len(r[1]), -r[0]), default=(0, []))
        return longest if len(longest[1]) > 1 else (0, [])

    def stitch(self, run: list[tuple]) -> list[int]:
        """Edges along the candidates, joined by shortest routes; ends where there is none."""
        path = [run[0][0]]
        for (a, off, _), (b, to, _) in zip(run, run[1:], strict=False):
            if a == b and to >= off:
                continue
            way = self.way(self.net.dst[a], self.net.src[b])
            if way is None:
                break
            path += [*way, b]
        return path


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    """Trajectories are small and their searches long: the tasks are not merged by bytes."""
    sc = rows.sparkSession.sparkContext
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism), by)


def match(points: DataFrame, edges: DataFrame, vertices: DataFrame, lines: DataFrame, k: int = 8, radius: float = 300.0, gps_error: float = 50.0, speed_bound: float = INF) -> DataFrame:
    """(traj_id, edges, offset, size, input_size) of the trajectories that match.

    ``offset`` and ``size`` tell which points the path covers.
    """
    shared = broadcast_net(edges, vertices)
    c = candidates(points, lines, k, radius, gps_error).select("traj_id", "pos", "e", "rank", "offset", "emission")
    d = points.select("traj_id", "pos", "x", "y", "t").join(c, ["traj_id", "pos"], "left")

    held: list[Matcher] = []  # one a task

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not held:
            held.append(Matcher(shared.value, speed_bound))
        matcher, net = held[0], shared.value
        pdf = pdf.sort_values(["pos", "rank"])
        layers, places, last = [], [], None
        for pos, x, y, t, e, off, em in zip(*(pdf[c].tolist() for c in ("pos", "x", "y", "t", "e", "offset", "emission")), strict=True):
            if pos != last:
                places.append((x, y, t))
                layers.append([])
                last = pos
            if e == e and e is not None:  # a point without candidates has one row without an edge
                layers[-1].append((net.index[int(e)], off, em))
        start, found = matcher.pieces(layers, places)
        names = ["traj_id", "edges", "offset", "size", "input_size"]
        if not found:
            return pd.DataFrame([], columns=names)
        path = [net.e[i] for i in matcher.stitch(found)]
        return pd.DataFrame([(pdf.traj_id.iloc[0], path, start, len(found), len(layers))], columns=names)

    return _dealt(d, F.col("traj_id")).groupBy("traj_id").applyInPandas(run, "traj_id string, edges array<long>, offset long, size long, input_size long")


def match_frechet(lines: DataFrame, edges: DataFrame, vertices: DataFrame, radius: float | None = None, lower: float = 5.0, precision: float = 0.1) -> DataFrame:
    """(traj_id, radius, edges): a path of the network within the Frechet distance ``radius``.

    Without ``radius`` the smallest one, by doubling from ``lower`` and bisection.
    """
    shared = broadcast_net(edges, vertices)

    def run(batches):
        import numpy as np

        for b in batches:
            rows = []
            for name, pts in zip(b["traj_id"], b["pts"], strict=True):
                line = np.array([(p["x"], p["y"]) for p in pts])
                if radius is None:
                    found = fr.best_graph_path(shared.value, line, lower, precision) if len(line) > 1 else None
                else:
                    path = fr.graph_path(shared.value, line, radius)
                    found = None if path is None else (radius, path)
                if found is not None:
                    rows.append((name, found[0], [shared.value.e[i] for i in found[1]]))
            yield pd.DataFrame(rows, columns=["traj_id", "radius", "edges"])

    # by another key than the one of the arrays, else the plan drops the step
    return _dealt(to_arrays(lines), F.xxhash64("traj_id")).mapInPandas(run, "traj_id string, radius double, edges array<long>")
