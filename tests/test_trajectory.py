"""Hand-checked cases of segmentation and clipping."""

from wayloom.operators import trajectory as tr


def points(spark, rows):
    return spark.createDataFrame(rows, "traj_id string, pos long, x double, y double, t double")


def walk(name, values):
    return [(name, k, float(x), 0.0, float(t)) for k, (x, t) in enumerate(values)]


def ids(df):
    return sorted({r.traj_id for r in df.collect()})


def test_split_gap_equal_stays_together(spark):
    p = points(spark, walk("a", [(0, 0), (0, 600), (0, 1200), (0, 1801)]))
    assert ids(tr.split_on_time(p, 600)) == ["a_part_0_2"]


def test_split_of_one_point_and_none(spark):
    assert ids(tr.split_on_time(points(spark, walk("a", [(0, 0)])), 600)) == []
    assert ids(tr.split_on_time(points(spark, []), 600)) == []


def test_positions_begin_at_zero(spark):
    p = points(spark, walk("a", [(0, 0), (0, 1), (0, 1000), (0, 1001)]))
    got = sorted((r.traj_id, r.pos, r.t) for r in tr.split_on_time(p, 600).collect())
    assert got == [("a_part_0_1", 0, 0.0), ("a_part_0_1", 1, 1.0), ("a_part_2_3", 0, 1000.0), ("a_part_2_3", 1, 1001.0)]


def test_box_needs_three_points_inside_the_line_but_two_at_its_end(spark):
    out, inn = (9, 0), (1, 0)
    mid = points(spark, walk("a", [inn, inn, out]))
    tail = points(spark, walk("a", [out, inn, inn]))
    three = points(spark, walk("a", [inn, inn, inn, out]))
    assert ids(tr.filter_box(mid, 0, 2, -1, 1)) == []
    assert ids(tr.filter_box(tail, 0, 2, -1, 1)) == ["a_bboxsub1_3"]
    assert ids(tr.filter_box(three, 0, 2, -1, 1)) == ["a_bboxsub0_3"]


def test_box_border_is_inside(spark):
    assert ids(tr.filter_box(points(spark, walk("a", [(2, 0), (2, 1)])), 0, 2, 0, 0)) == ["a_bboxsub0_2"]


def test_graph_box_keeps_own_coordinates(spark):
    p = points(spark, walk("a", [(100, 0), (101, 0)])).selectExpr("*", "0.0D as gx", "0.0D as gy")
    v = spark.createDataFrame([(0, -1.0, -1.0), (1, 1.0, 1.0)], "v long, x double, y double")
    got = tr.filter_graph_box(p, v, 1.0).collect()
    assert [r.x for r in got] == [100.0, 101.0]


def test_length_filter_counts_points(spark):
    p = points(spark, walk("a", [(0, 0)] * 3) + walk("b", [(0, 0)] * 2))
    assert ids(tr.filter_min_points(p, 3)) == ["a"]


def test_arrays_round_trip_and_backward_steps(spark):
    p = points(spark, walk("a", [(0, 5), (1, 3), (2, 4)]))
    assert sorted(map(tuple, tr.from_arrays(tr.to_arrays(p)).collect())) == sorted(map(tuple, p.collect()))
    assert [r.pos for r in tr.backward_steps(p).collect()] == [1]
    assert tr.columns_form(p).first().n_back == 1


def test_match_by_id(spark):
    a, b = points(spark, walk("a", [(0, 0)]) + walk("b", [(0, 0)])), points(spark, walk("b", [(1, 0)]))
    assert [r.traj_id for r in tr.match_by_id(a, b).collect()] == ["b"]
