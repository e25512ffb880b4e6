"""Scalars against hand-derived values, and algebraic properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import matrix as m
from pointloom.functions import quaternion as q
from pointloom.functions import text
from pointloom.functions import vector as v
from pointloom.operators import boxes, events, moments


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-6), (got, want)


def test_hash_colours(spark):
    for label, want in ((0, (0, 0.817843844, 0.635687687)), (1, (0.459386138, 0.279187875, 0.094144469)), (2, (0.918772275, 0.735937699, 0.558375749)), (1431655766, (0.635687687, 0.459386138, 0.279187875))):
        close(one(spark, *text.hash_colour(F.lit(label))), want)


def test_scalar_on_the_left(spark):
    close(one(spark, *v.scalar_minus(1, v.vec(3, 3, 3)), *v.scalar_minus_exact(1, v.vec(3, 3, 3))), (2, 2, 2, -2, -2, -2))
    close(one(spark, *v.scalar_over(6, v.vec(3, 3, 3)), *v.scalar_over_exact(6, v.vec(3, 3, 3))), (0.5, 0.5, 0.5, 2, 2, 2))


def test_zero_and_parallel(spark):
    close(one(spark, *v.normalize(v.vec(0, 0, 0)), *v.normalize4(v.vec(0, 0, 0, 1e-9))), (0,) * 7)
    close(one(spark, *v.line_plane(v.vec(0, 0, 0), v.vec(1, 0, 0), v.vec(0, 1, 0), v.vec(0, 1, 0))), (math.nan,) * 3)
    close(one(spark, *v.orbit_eye(v.vec(0, 0, 0), 5, 90, 0)), (5, 0, 0))


def test_validity(spark):
    assert one(spark, *[v.valid(v.vec(x)) for x in (float("nan"), 3.402823466e36, float("-inf"), 1.0)]) == (False, False, True, True)


def test_text(spark):
    assert one(spark, text.split_any(F.lit("v  1.0\t2 "), " \t"), text.split_any(F.lit("1//3"), "/", True), text.split_any(F.lit("1/"), "/", True)) == (["v", "1.0", "2"], ["1", "", "3"], ["1"])
    assert one(spark, text.to_int(F.lit("")), text.to_int(F.lit("12x")), text.to_float(F.lit(" 1.5e2z")), text.to_float(F.lit("q")), text.to_float_or_zero(F.lit("q"))) == (None, 12, 150.0, None, 0.0)
    for word, want in (("RED", (1, 0, 0)), ("negative z", (0, 0, -1)), ("0.5", (0.5,) * 3), ("bogus", (0, 0, 0))):
        close(one(spark, *v.keyword(F.lit(word))), want)
    assert one(spark, *[v.six_digits(F.lit(x)) for x in (0.5, 1234567.0, 0.00001234, 100.0, float("nan"))]) == ("0.5", "1.23457e+06", "1.234e-05", "100", "nan")


def test_quaternions(spark):
    close(one(spark, *q.identity(), *q.identity_exact()), (0, 0, 0, 1, 1, 0, 0, 0))
    close(one(spark, *q.between(v.vec(1, 0, 0), v.vec(-1, 0, 0))), (0, 0, 1, 0))
    r = random.Random(1)
    for _ in range(3):
        a, b = [r.uniform(-1, 1) for _ in range(3)], [r.uniform(-1, 1) for _ in range(3)]
        turn = q.about(r.uniform(-3, 3), v.normalize(v.vec(*b)))
        close(one(spark, *q.rotate(q.rotate(v.vec(*a), turn), q.conjugate(turn))), a)
        close(one(spark, *v.cross(v.normalize(v.vec(*b)), q.rotate(v.normalize(v.vec(*a)), q.between(v.vec(*a), v.vec(*b))))), (0, 0, 0))


def test_matrices(spark):
    r = random.Random(2)
    for n in (3, 4):
        a = m.matrix([[r.uniform(-1, 1) for _ in range(n)] for _ in range(n)])
        got = one(spark, *[c for row in m.multiply(a, m.inverse(a)) for c in row])
        close(got, [float(i == j) for i in range(n) for j in range(n)])
    d = m.matrix([[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]])
    close(one(spark, *[c for row in m.inverse4(d) for c in row]), [0.5, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    close(one(spark, *[c for row in m.inverse(m.zero(3)) for c in row]), [1, 0, 0, 0, 1, 0, 0, 0, 1])
    moved = m.translate(m.identity(4), v.vec(1, 2, 3))
    close(one(spark, *m.transform_point(moved, v.vec(1, 1, 1)), *m.transform_vector_exact(moved, v.vec(1, 1, 1))), (2, 3, 4, 1, 1, 1))


def test_boxes(spark):
    bar = lambda *x: v.vec(*x)
    a, b = bar(-5, -1, -1, 5, 1, 1), bar(-1, -5, -1, 1, 5, 1)
    assert one(spark, boxes.intersects(a, b), boxes.intersects_exact(a, b)) == (False, True)
    unit = bar(-1, -1, -1, 1, 1, 1)
    inside, low, high = [[v.vec(x + d, y + d, d) for x, y in ((0, 0), (0.5, 0), (0, 0.5))] for d in (0.1, -9, 9)]
    assert one(spark, boxes.intersects_triangle(unit, *inside, exact=True), boxes.intersects_triangle(unit, *low, exact=True), boxes.intersects_triangle(unit, *high)) == (True, False, False)
    assert one(spark, boxes.contains(unit, v.vec(1, 1, 1)), boxes.contains(unit, v.vec(1, 1, 1.1))) == (True, False)


def test_moments(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 0.0, 0.0, 6.0)], "idx long, x double, y double, z double")
    close(tuple(moments.mean(p).first())[:3], (0.5, 1, 1.5))
    want = (0.75, -0.5, -0.75, 3, -1.5, 6.75)
    close(tuple(moments.second_moments(moments.centred(p)).first()), want)
    close(tuple(moments.covariance(p).first()), want)
    box = boxes.aabb(p).select(*boxes.centre(boxes.columns())).first()
    close(tuple(box), (1, 2, 3))
    empty = boxes.aabb(p.where("idx < 0")).first()
    assert empty.minx is None and empty.n == 0


def test_trackball(spark):
    rows = [(1, 0, "press", 0.0, 0.0, 1, None, None), (1, 1, "move", 314.159265358979, 0.0, None, None, None), (1, 2, "release", None, None, 1, None, None), (1, 3, "move", 9.0, 9.0, None, None, None)]
    rows += [(2, 0, "wheel", None, None, None, 1.0, None), (2, 1, "key_press", None, None, None, None, "W"), (2, 2, "press", 0.0, 0.0, 2, None, None), (2, 3, "move", 10.0, 20.0, None, None, None), (2, 4, None, None, None, None, None, None)]
    rows += [(None, 0, "key_press", None, None, None, None, "LEFT_SHIFT"), (None, 1, "wheel", None, None, None, -1.0, None), (None, 2, "key_release", None, None, None, None, "LEFT_SHIFT"), (None, 3, "wheel", None, None, None, -1.0, None)]
    e = spark.createDataFrame(rows, "session int, at int, kind string, x double, y double, button int, dy double, key string")
    got = {(x.session, x.at): x for x in events.trackball(e, order=("at",)).collect()}
    assert len(got) == len(rows)
    eye, target = lambda k: tuple(got[k][f"eye_{a}"] for a in "xyz"), lambda k: tuple(got[k][f"target_{a}"] for a in "xyz")
    close(eye((1, 0)), (0, 0, 5))
    close(eye((1, 1)), (-10, 0, 0))  # a quarter turn, at the fold's own radius
    close(eye((1, 3)), (-10, 0, 0))
    close(eye((2, 0)), (0, 0, 9))
    close(eye((2, 1)), (0, 0, 8.8))
    close(target((2, 1)), (0, 0, -0.2))
    close(eye((2, 3)), (-0.1, 0.2, 8.8))
    close(eye((2, 4)), (-0.1, 0.2, 8.8))
    close((got[None, 1].fov, got[None, 1].radius, got[None, 3].fov, got[None, 3].radius), (46, 10, 46, 11))
    assert events.trackball(e.where("at < 0"), order=("at",)).collect() == []
