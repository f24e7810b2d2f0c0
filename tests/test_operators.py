"""Operators on small networks: quirks, invariants, and plans that stay pruned."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions import frechet as fr
from wayloom.operators import decompose as dc
from wayloom.operators import field as fl
from wayloom.operators import frechet as fz
from wayloom.operators import matching as mt
from wayloom.operators import network as nw
from wayloom.operators import nets
from wayloom.operators import spatial as sp
from wayloom.plans import experiment as ex
from wayloom.streaming import sessions as ss


def edge(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "e long, src long, dst long, length double")


def grid(spark, n=4, step=1.0):
    v = [(k, (k % n) * step, (k // n) * step) for k in range(n * n)]
    rows = []
    for k in range(n * n):
        for to in [k + 1] * (k % n < n - 1) + [k + n] * (k < n * (n - 1)):
            rows += [(k, to, step), (to, k, step)]
    return spark.createDataFrame(v, "v long, x double, y double"), edge(spark, sorted(rows))


def line(spark, lines):
    rows = [(name, k, float(x), float(y), float(k)) for name, pts in lines.items() for k, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "traj_id string, pos long, x double, y double, t double")


def test_few_candidates_are_all_kept_though_far(spark):
    e = spark.createDataFrame([(0, 0.0, 4.0, 10.0, 4.0), (1, 4.0, 4.0, 4.0, 9.0)], "e long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(0, 0.0, 0.0)], "id long, px double, py double")
    got = sp.nearest_edges(p, e, ["id"], 8, 4.5).orderBy("rank").collect()
    assert [r.e for r in got] == [0, 1] and got[1].dist > 4.5


def test_residual_and_degeneracy_and_prune(spark):
    f = spark.createDataFrame([(0, 2.0), (1, 1.0)], "e long, value double")
    b, c = spark.createDataFrame([(0, 0, 0)], "b long, pos long, e long"), spark.createDataFrame([(0, 1.5)], "b long, coef double")
    assert sorted(map(tuple, fl.residual(f, b, c).collect())) == [(0, 0.5), (1, 1.0)]
    p = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 1.0), (0, 2, 1, 1.0)], "path_id long, pos long, e long, value double")
    assert tuple(fl.degeneracy(f, p).first()) == (2, 1.0, 1, 1)
    co = spark.createDataFrame([(0, 0.5), (1, 1e-6), (2, 0.2)], "b long, coef double")
    assert [r.b for r in fl.prune(co).orderBy("b").collect()] == [0, 2]
    assert [r.b for r in fl.prune_sorted(co).collect()] == [0, 2]
    ties = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0)], "b long, coef double")
    assert sorted(r.b for r in fl.top_weighted(ties, 2).collect()) == [1, 2]


@pytest.mark.parametrize("coefs,n", [([1, 1, 2], 2), ([2, 1, 1], 2), ([1, 3, 1, 2, 1, 3, 2, 2], 4), ([1, 1, 1], 5), ([2, 2, 2, 3, 2], 3)])
def test_top_weighted_ties(spark, coefs, n):
    held = []
    for b, c in enumerate(coefs):
        if len(held) < n:
            held.append((c, b))
        elif c > min(held)[0]:
            held[held.index(min(held))] = (c, b)
    d = spark.createDataFrame([(b, float(c)) for b, c in enumerate(coefs)], "b long, coef double")
    assert [(r.coef, r.b) for r in fl.top_weighted(d, n).collect()] == sorted(held)


def test_field_plus_decomposition_is_whole(spark):
    f = spark.createDataFrame([(k, float(k)) for k in range(5)], "e long, value double")
    b = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 2)], "b long, pos long, e long")
    c = spark.createDataFrame([(0, 0.5), (1, 0.25)], "b long, coef double")
    whole = fl.residual(f, b, c).join(fl.decomposition_field(f, b, c).withColumnRenamed("value", "w"), "e")
    assert all(r.value + r.w == pytest.approx(float(r.e)) for r in whole.collect())
    assert fl.field_stats(f.where("e < 0")).first().max_value == 0.0


def test_distances_by_joins_equal_the_kernel(spark):
    v, e = grid(spark)
    e = e.withColumn("length", 1 + F.pmod(F.xxhash64("e"), F.lit(7)).cast("double"))
    net = nets.collected(e, v)
    got = {r.v: r.dist for r in nets.distances(e, v.where("v = 0")).collect()}
    assert got == net.distances(0)[0]
    bounded = {r.v for r in nets.distances(e, v.where("v = 0"), bound=5.0).collect()}
    assert bounded == set(net.distances(0, 5.0)[0])


def test_large_networks_are_not_broadcast(spark, monkeypatch):
    v, e = grid(spark)
    monkeypatch.setattr(nets, "MOST_EDGES", 3)
    with pytest.raises(ValueError):
        nets.collected(e, v)


def test_closest_vertex_far_away_and_none(spark):
    v = spark.createDataFrame([(7, 0.0, 0.0), (3, 10.0, 0.0)], "v long, x double, y double")
    p = spark.createDataFrame([(0, 5.0, 0.0), (1, 5000.0, 0.0)], "id long, px double, py double")
    assert {r.id: r.v for r in sp.closest_vertices(p, v, ["id"]).collect()} == {0: 3, 1: 3}
    assert {r.v for r in sp.closest_vertices(p, v.where("v < 0"), ["id"]).collect()} == {-1}


def test_buffers_of_single_points_are_empty(spark):
    v, _ = grid(spark)
    assert sp.buffers(line(spark, {"a": [(0, 0)]}), v, 5.0).count() == 0
    assert sp.buffers(line(spark, {"a": [(0, 0), (0, 0)]}), v, 0.5).count() == 1


def test_matching_follows_a_staircase(spark):
    v, e = grid(spark, 5, 100.0)
    lines = nw.with_lengths(v, e)
    p = line(spark, {"a": [(10, 3), (90, -4), (190, 5), (204, 80), (198, 190)], "one": [(0, 0)], "far": [(9000, 0), (9100, 0)]})
    got = mt.match(p, e, v, lines, k=4, radius=60.0, gps_error=20.0).collect()
    assert [r.traj_id for r in got] == ["a"]
    net = nets.collected(e, v)
    path = [net.index[x] for x in got[0].edges]
    assert all(net.dst[a] == net.src[b] for a, b in itertools.pairwise(path))
    assert [net.src[i] for i in path][:2] == [0, 1] and (got[0].offset, got[0].size, got[0].input_size) == (0, 5, 5)


def test_transition_and_emission():
    assert mt.transition(20.0, 20.0) == pytest.approx(1.0)
    assert mt.transition(10.0, 20.0) == pytest.approx(0.5)


def test_frechet_table_and_nearest_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = {str(k): rng.integers(0, 40, (4, 2)).tolist() for k in range(8)}
    d = line(spark, pts)
    got = {(r.a, r.b): r.distance for r in fz.table(d, d, 1e-3, 25.0).collect()}
    every = {(a, b): fr.distance(np.array(p, float), np.array(q, float), 1e-3) for a, p in pts.items() for b, q in pts.items()}
    assert set(got) == {k for k, x in every.items() if x <= 25.0}
    assert all(got[k] == pytest.approx(every[k], abs=0.01) for k in got)
    near = {r.a: (r.distance, r.b) for r in fz.nearest(d.where("traj_id < '4'"), d.where("traj_id >= '4'"), 1e-3).collect()}
    for a in "0123":
        best = min(every[a, b] for b in "4567")
        assert near[a][0] == pytest.approx(best, abs=0.01)


def test_nearest_without_candidates(spark):
    a, b = line(spark, {"a": [(0, 0), (1, 0)]}), line(spark, {"b": [(90, 0), (91, 0)]})
    assert tuple(fz.nearest(a, b, 0.1, 10.0).first()) == ("a", 10.0, None)


def test_coverage(spark):
    d = line(spark, {"a": [(0, 0), (9, 0)], "b": [(0, 1), (9, 1)], "c": [(0, 2), (9, 2)]})
    assert tuple(fz.coverage(d, d, 1.0).first()) == (1, pytest.approx(1 / 3))
    assert fz.coverage(d.where("traj_id = 'a'"), d, 1.0).first().n_used is None
    assert tuple(fz.coverage(d, d, 1.0, exact_pairs=0).first()) == (1, pytest.approx(1 / 3))


@pytest.mark.parametrize("name", sorted(dc.DECOMPOSERS))
def test_decomposers_explain_part_of_the_field(spark, name):
    v, e = grid(spark)
    net = nets.collected(e, v)
    path = net.shortest(0, 15)[1]
    f = e.select("e", F.when(F.col("e").isin([net.e[i] for i in path]), 3.0).otherwise(0.0).alias("value"))
    rep = line(spark, {"r": [net.xy[0], *(net.xy[net.dst[i]] for i in path)]}).drop("t")
    p = dc.Problem(e, v, f, rep, 1.1)
    r = dc.decompose(p, dc.DECOMPOSERS[name]())
    assert r.objective < 9 * len(path) * (1.0 if name == "frechet_band" else 0.35)
    assert all(x.coef >= 1e-5 for x in r.coefs.collect())
    rows = {}
    for x in r.basis.orderBy("b", "pos").collect():
        rows.setdefault(x.b, []).append(net.index[x.e])
    assert all(net.dst[a] == net.src[b] for q in rows.values() for a, b in itertools.pairwise(q))
    if name == "trivial":
        assert r.objective == pytest.approx(0.0, abs=1e-6)


def test_fit_modes_agree(spark):
    v, e = grid(spark, 3)
    f = e.select("e", (F.col("e") % 3 + 1).cast("double").alias("value"))
    p = dc.Problem(e, v, f, line(spark, {"r": [(0, 0), (2, 2)]}).drop("t"), 1.0)
    basis = spark.createDataFrame([(b, "", pos, (b * 5 + pos) % 24) for b in range(6) for pos in range(3)], "b long, src_repr string, pos int, e long")
    sums = []
    for mode in ("full", "batched", "greedy"):
        bs, co = dc.fit(p, basis, 1e-5, mode, batch=2)
        sums.append(fl.square_length(fl.residual(f, bs, co)).first().objective)
    assert sums[1] == pytest.approx(sums[0], abs=1e-4) and sums[2] == pytest.approx(sums[0], abs=1e-4)


def test_experiment_grid():
    s = {"name": "x", "problemInstance": {"epsilon": 1}, "runMode": "allPairs", "runParameters": {"problemInstance.epsilon": [10, 25], "problemInstance.pathSelect.seed": [1, 2, 3]}}
    assert len(ex.runs(s)) == 6
    assert ex.runs(s | {"runMode": "combinations"})[1]["problemInstance"] == {"epsilon": 25, "pathSelect": {"seed": 2}}
    assert ex.runs(s | {"runMode": "single"}) == [{"name": "x", "problemInstance": {"epsilon": 1}}]
    assert ex.get_path(ex.set_path({}, "a.b", 1), "a.b") == 1 and ex.delete_path({"a": {"b": 1}}, "a.b") == {"a": {}}
    for share, number in (("fraction", "fixed"), ("percentage", "count")):
        assert len(ex.select_ids(list("abcdefghij"), 3, share, 0.25)) == 2
        assert ex.select_ids(list("abcdefghij"), 3, share, 0.25) == ex.select_ids(list("abcdefghij"), 3, number, 2)
    with pytest.raises(ValueError):
        ex.select_ids([1, 2], 3, "other", 1)
    assert ex.parse_result_name("it=3-0_newbasis-alg.txt") == {"it": 3, "step": 0, "what": "newbasis", "alg": "alg"}


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 600), ("a", 1200), ("a", 5000), ("b", 100), ("b", 200), ("z", 90000), ("z", 90001), ("z", 200000)]
    d = spark.createDataFrame([(n, s, 0.0, 0.0) for n, s in rows], "traj_id string, s long, x double, y double")
    d = d.select("traj_id", F.timestamp_seconds("s").alias("ts"), "x", "y")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = ss.sessions(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("pieces").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.traj_id, r.n) for r in spark.table("pieces").collect())
    assert got == [("a", 3), ("b", 2), ("z", 2)]


def test_scans_are_pruned_and_joins_are_equi_joins(spark, tmp_path):
    v, e = grid(spark)
    v.write.parquet(f"{tmp_path}/v")
    vv = spark.read.parquet(f"{tmp_path}/v")
    d = sp.vertices_in_boxes(spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0)], "box_id long, x_min double, x_max double, y_min double, y_max double"), vv)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_matching_queries_run_on_every_point(spark):
    from wayloom.plans import fixtures, iterative

    d = "/root/testdata/sf0.001"
    lines, points = iterative.short_lines(spark, d), fixtures.points(spark, d)
    assert lines.select("traj_id", "pos").exceptAll(points.select("traj_id", "pos")).isEmpty() and lines.count() == points.count()
    assert lines.where("x < 0 OR y < 0 OR x > 2000 OR y > 2000").isEmpty()


def test_intervals_that_meet_in_one_place_are_one(spark):
    """A corner at exactly the radius: both cells are the place 1 alone, a tie in every order by (lo, hi)."""
    v = spark.createDataFrame([(0, 200.0, 2000.0)], "v long, x double, y double")
    p = line(spark, {"a": [(218, 71), (168, 1976), (164, 1966)]}).drop("t")
    assert [tuple(r) for r in fz.merged_intervals(p, v, 40.0).collect()] == [("a", 0, 1.0, 1.0, 2)]


def test_selection_of_a_table_equals_that_of_a_list_and_collects_nothing(spark, monkeypatch):
    from wayloom.plans import QUERIES

    ids = [3 * k for k in range(1000)]
    d = spark.createDataFrame([(k,) for k in ids], "id long").repartition(7)
    for mode, value in (("percentage", 0.05), ("count", 30), ("fraction", 1.0), ("fixed", 0)):
        got = sorted(map(tuple, ex.select_rows(d, "id", 7, mode, value).collect()))
        assert [r[1] for r in got] == ex.select_ids(ids, 7, mode, value) and [r[0] for r in got] == list(range(len(got)))
    with pytest.raises(ValueError):
        ex.select_rows(d, "id", 7, "other", 1)
    monkeypatch.setattr(ex, "select_ids", None)  # the query holds no list of ids
    assert tuple(QUERIES["seeded_selection"](spark, "/root/testdata/sf0.001").first()) == (73, True, True)


def test_chunks_of_any_size_give_equal_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = {str(k): rng.integers(0, 30, (rng.integers(1, 6), 2)).tolist() for k in range(30)}
    d = line(spark, pts)
    left, right = d.where("traj_id < '2'"), d.where("traj_id >= '2'")
    every = {(a, b): fr.distance(np.array(p, float), np.array(q, float), 0.1) for a, p in pts.items() for b, q in pts.items()}
    best = {a: min((x, b) for (c, b), x in every.items() if c == a and b >= "2") for a in pts if a < "2"}
    for size, held in ((256, 4096), (2, 3)):
        monkeypatch.setattr(fz, "CHUNK", size)
        monkeypatch.setattr(fz, "MEASURED", held)
        assert {(r.a, r.b) for r in fz.table(d, d, 0.1, 9.0).collect()} == {k for k, x in every.items() if fr.within(np.array(pts[k[0]], float), np.array(pts[k[1]], float), 9.0)}
        assert {r.a: (r.distance, r.b) for r in fz.nearest(left, right).collect()} == best
        assert tuple(fz.distortion(left, right).first()) == (pytest.approx(np.mean([x for x, _ in best.values()])), len(best))


def test_searches_for_few_lines_are_dealt_to_many_tasks(spark):
    v, e = grid(spark)
    p = line(spark, {str(k): [(0, 0), (1, 0), (2, 0)] for k in range(40)})
    d = mt.match_frechet(p, e, v, lower=0.1, precision=0.1)
    assert d.count() == 40
    assert d.select(F.spark_partition_id()).distinct().count() > 4


def test_products_of_representatives_and_members_are_those_of_all(spark):
    rng = np.random.default_rng(8)
    rows = [(b, k, int(e)) for b in range(40) for k, e in enumerate(rng.integers(0, 4, rng.integers(1, 4)))]
    basis = spark.createDataFrame(rows, "b long, pos long, e long")
    field = spark.createDataFrame([(e, 1.0) for e in range(4)], "e long, value double")
    products, same = fl.gram_by_class(basis, field)
    got, rep = {(r.b1, r.b2): r.dot for r in products.collect()}, {r.b: r.rep for r in same.collect()}
    want = {(r.b1, r.b2): r.dot for r in fl.gram(basis, field)[0].collect()}
    every = {(a, b): got[min(rep[a], rep[b]), max(rep[a], rep[b])] for a in range(40) for b in range(a, 40) if (min(rep[a], rep[b]), max(rep[a], rep[b])) in got}
    assert every == want and len(got) < len(want) and set(rep) == set(range(40))


def test_products_by_class_are_summed_where_they_arise(spark, monkeypatch):
    basis = spark.createDataFrame([(b, pos, (b % 5 * 3 + pos) % 7) for b in range(12) for pos in range(4)], "b long, pos int, e long")
    field = spark.createDataFrame([(k, 1.0) for k in range(7)], "e long, value double")
    products, same = fl.gram_by_class(basis, field)
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(b1" in plan and not re.search(r"hashpartitioning\(b1#\d+L?, b2", plan)  # pairs are not shuffled
    rows, reps = sorted(products.collect()), sorted(same.collect())
    assert all(r.rep == r.b % 5 for r in reps)
    monkeypatch.setattr(fl, "MOST_CLASSES", 0)
    monkeypatch.setattr(fl, "MOST_SHARED", 0)
    products, same = fl.gram_by_class(basis, field)
    assert (sorted(products.collect()), sorted(same.collect())) == (rows, reps)


def turning(rng, n: int) -> dict[str, list]:
    """Lines that go to and fro, some of them with other numbers of turns, each beside its place."""
    out = {}
    for k in range(n):
        step = np.abs((np.arange(rng.integers(8, 20)) + 6) % 12 - 6)
        out[f"{k:02}"] = np.stack([step * 12.0, step * 8.0], 1) + np.cumsum(rng.integers(-2, 3, (len(step), 2)), 0) + rng.integers(0, 10, 2)
    return out


def test_marks_leave_out_no_pair_within_the_radius():
    rng = np.random.default_rng(4)
    p = fr.Lines.joined([*turning(rng, 80).values()])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80)))
    middle = (float(p.x.min() + p.x.max()) / 2, float(p.y.min() + p.y.max()) / 2)
    for radius in (3.0, 6.0, 12.0, 20.0):
        marks, key = fr.marks(p, radius, middle)
        near = fr.within_many(p, i, p, j, np.full(len(i), radius))
        far = (np.abs(marks[i] - marks[j]) > radius + 1e-6).any(1) | ((key[i] != key[j]) & (key[i] != 0) & (key[j] != 0))
        ends = fr.end_bounds(p, p)[i, j] <= radius
        assert near.sum() >= 80 + 100 * (radius > 10) and not (near & far).any() and (ends & far).sum() > 0


def test_table_and_nearest_of_turning_lines_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = turning(rng, 60)
    d = line(spark, {k: p.tolist() for k, p in pts.items()})
    every = {(a, b): fr.distance(p, q, 1e-3) for a, p in pts.items() for b, q in pts.items()}
    monkeypatch.setattr(fz, "PART", 7)
    monkeypatch.setattr(fz, "CHUNK", 5)
    got = {(r.a, r.b): r.distance for r in fz.table(d, d, 1e-3, 14.05).collect()}
    assert len(got) > 100 and set(got) == {k for k, x in every.items() if x <= 14.05}
    assert all(got[k] == pytest.approx(every[k], abs=0.01) for k in got)
    near = fz.nearest(d.where("traj_id < '30'"), d.where("traj_id >= '30'"), 1e-3).collect()
    assert len(near) == 30
    for r in near:
        assert r.distance == pytest.approx(min(every[r.a, f"{b}"] for b in range(30, 60)), abs=0.01)
