"""Routes between vertex pairs, one row a pair, by broadcast search kernels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.graph import INF, Net
from .nets import broadcast_net

ROUTE = "source long, sink long, cost double, edges array<long>"


def _each(net: Net, kind: str, source: int, sink: int, bound: float, weight: list[float] | None):
    if kind == "dijkstra":
        return net.shortest(source, sink, bound, weight)
    if kind == "astar":
        return net.shortest(source, sink, bound, weight, net.straight(sink))
    if kind == "fewest":
        return net.shortest(source, sink, bound, [1.0] * len(net.e))
    if kind == "bellman_ford":
        dist, before = net.bellman_ford(source, weight or net.length)
        return (dist[sink], net.walk_back(before, sink)) if sink in dist else None
    if kind == "widest":
        return net.widest(source, sink, weight or net.length)
    if kind == "dag_longest":
        return net.dag_longest(source, sink, weight)
    if kind == "long":
        return net.long_path(source, sink, weight)
    raise ValueError(kind)


def routes(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, kind: str = "dijkstra", bound: float = INF, weights: dict[int, float] | None = None) -> DataFrame:
    """(source, sink, cost, edges) of pairs (source, sink) that have a route of that kind.

    Kinds: dijkstra, astar, fewest (edges), bellman_ford, widest, dag_longest, long.
    ``weights`` (by edge id) replace the lengths.
    """
    shared = broadcast_net(edges, vertices)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        weight = None if weights is None else [weights.get(e, 0.0) for e in net.e]
        for b in batches:
            rows = []
            for s, t in zip(b["source"].tolist(), b["sink"].tolist(), strict=True):
                found = _each(net, kind, s, t, bound, weight)
                if found is not None:
                    rows.append((s, t, found[0], [net.e[i] for i in found[1]]))
            yield pd.DataFrame(rows, columns=["source", "sink", "cost", "edges"])

    return pairs.select("source", "sink").mapInPandas(run, ROUTE)


def max_flow(edges: DataFrame, vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, sink, value) of the largest flow with the edge lengths as capacities."""
    shared = broadcast_net(edges, vertices)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            value = [shared.value.max_flow(s, t, shared.value.length)[0] for s, t in zip(b["source"].tolist(), b["sink"].tolist(), strict=True)]
            yield pd.DataFrame({"source": b["source"], "sink": b["sink"], "value": value})

    return pairs.select("source", "sink").mapInPandas(run, "source long, sink long, value double")
