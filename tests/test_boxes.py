"""Joins of boxes against brute force, for sizes over many levels."""

import math
import random
import threading

import numpy as np
import pytest

from pointloom.operators import boxes

INF, NAN = math.inf, math.nan
BOX = "id long, minx double, miny double, minz double, maxx double, maxy double, maxz double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(120):
        length = 10 ** rng.uniform(-3, 2)
        at = [rng.uniform(-3, 3) for _ in range(3)]
        out.append((i, *at, *[c + length * rng.uniform(0.1, 1) for c in at]))
    # the whole space, a point, one beyond the cells of a long, and ones that meet nothing
    out += [(900, -INF, -INF, -INF, INF, INF, INF), (901, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (902, -1e30, -1.0, -1.0, 1e30, 1.0, 1.0)]
    return out + [(903, None, 0.0, 0.0, 9.0, 9.0, 9.0), (904, NAN, 0.0, 0.0, 9.0, 9.0, 9.0), (905, 1000.0, 0.0, 0.0, -1000.0, 9.0, 9.0)]


def meet(a, b):
    return all(a[i] <= b[i + 3] and b[i] <= a[i + 3] for i in range(3))


def test_boxes_with_points(spark, rows):
    rng = random.Random(6)
    points = [(k, *[rng.uniform(-4, 4) for _ in range(3)]) for k in range(200)] + [(500, 0.0, 0.0, 0.0), (501, 5e20, 0.5, 0.5), (502, None, 0.0, 0.0), (503, NAN, 0.0, 0.0)]
    found = boxes.boxes_with_points(spark.createDataFrame(rows, BOX), spark.createDataFrame(points, "p long, x double, y double, z double"), 0.05)
    assert found.columns == ["id", *boxes.NAMES, "p", "x", "y", "z"]
    got = sorted((r.id, r.p) for r in found.collect())
    assert got == sorted((b[0], p[0]) for b in rows if b[0] < 903 for p in points if p[0] < 502 and meet(b[1:], p[1:] * 2))


def test_boxes_with_boxes(spark, rows):
    got = sorted(tuple(r) for r in boxes.boxes_with_boxes(spark.createDataFrame(rows, BOX), "id", 0.05).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] < 903 and meet(a[1:], b[1:]))


def cornered(a, b):
    inside = lambda x, y: all(x[i] <= y[i] <= x[i + 3] or x[i] <= y[i + 3] <= x[i + 3] for i in range(3))
    return inside(a, b) or inside(b, a)


@pytest.mark.parametrize(("held", "tested", "batch"), [(8192, 1 << 20, 10000), (9, 40, 16)])
def test_corners_in_boxes(spark, rows, monkeypatch, held, tested, batch):
    """Against brute force, with parts, candidates and batches cut small, too; long boxes across each other, equal ones, an id twice."""
    rng = random.Random(8)
    long = []
    for i in range(300, 420):
        half = [(0.4, 0.02, 0.1), (0.02, 0.4, 0.1), (0.0, 0.0, 0.5)][i % 3]
        at = [round(rng.uniform(-0.6, 0.6), 1) for _ in range(3)]
        long.append((i, *[c - h for c, h in zip(at, half)], *[c + h for c, h in zip(at, half)]))
    every = rows + long + [(299, *long[5][1:]), (None, *long[5][1:]), (300, *long[7][1:]), (298, -INF, 0.0, 0.0, -INF, 0.1, 0.1), (297, -INF, 0.1, 0.0, -INF, 0.2, 0.1)]
    monkeypatch.setattr(boxes, "HELD", held)
    monkeypatch.setattr(boxes, "TESTED", tested)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = boxes.boxes_with_boxes(spark.createDataFrame(every, BOX), "id", 0.05, exact=False)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    finite = [r for r in every if r[0] is not None and r[0] < 903]
    assert got == sorted((a[0], b[0]) for a in finite for b in finite if a[0] < b[0] and cornered(a[1:], b[1:])) and len(got) > 1000
    assert found.columns == ["a", "b"]
    words = spark.createDataFrame([(f"k{r[0]}", *r[1:]) for r in finite[-40:]], BOX.replace("id long", "id string"))
    by_word = sorted(tuple(r) for r in boxes.boxes_with_boxes(words, "id", 0.05, exact=False).collect())
    assert by_word == sorted((f"k{a[0]}", f"k{b[0]}") for a in finite[-40:] for b in finite[-40:] if f"k{a[0]}" < f"k{b[0]}" and cornered(a[1:], b[1:]))


def test_many_long_boxes(spark):
    """12,000 long boxes that nearly all share their cells; joined pair by pair they took minutes."""
    n, half = 12000, np.array([[0.2, 0.01, 0.05], [0.01, 0.2, 0.05]])[np.arange(12000) % 2]
    at = np.random.default_rng(9).normal(0, 0.125, (n, 3))
    low, high = at - half, at + half
    want = 0
    for i in range(n - 1):
        a, b, c, d = low[i], high[i], low[i + 1 :], high[i + 1 :]
        inside = (((a <= c) & (c <= b)) | ((a <= d) & (d <= b))).all(axis=1)
        want += (inside | (((c <= a) & (a <= d)) | ((c <= b) & (b <= d))).all(axis=1)).sum()
    df = spark.createDataFrame([(i, *map(float, low[i]), *map(float, high[i])) for i in range(n)], BOX)
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert boxes.boxes_with_boxes(df, "id", 0.2, exact=False).count() == want
    finally:
        late.cancel()


def test_boxes_with_triangles(spark, rows):
    rng = random.Random(7)
    triangles = []
    for k in range(80):
        length, at = 10 ** rng.uniform(-3, 1.5), [rng.uniform(-3, 3) for _ in range(3)]
        triangles.append((k, *[at[i % 3] + length * rng.uniform(-1, 1) for i in range(9)]))
    names = [f"{a}{c}" for c in range(3) for a in "xyz"]
    t = spark.createDataFrame(triangles, "triangle long, " + ", ".join(f"{n} double" for n in names))
    finite = [r for r in rows if r[0] < 900]
    b = spark.createDataFrame(finite, BOX).withColumnRenamed("id", "box")
    corner = lambda k: tuple(boxes.F.col(f"{a}{k}") for a in "xyz")
    all_ = b.crossJoin(t).where(boxes.intersects_triangle(boxes.columns(), corner(0), corner(1), corner(2), True)).select("box", "triangle")
    got = sorted(tuple(r) for r in boxes.boxes_with_triangles(b, t, 0.05, exact=True).collect())
    assert got == sorted(tuple(r) for r in all_.collect()) and len(got) > 100


def test_empty_tables(spark, rows):
    none, some = spark.createDataFrame([], BOX), spark.createDataFrame(rows, BOX)
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "p long, x double, y double, z double")
    assert boxes.boxes_with_points(none, points, 1.0).isEmpty() and boxes.boxes_with_points(some, points.limit(0), 1.0).isEmpty()
    assert boxes.boxes_with_boxes(none, "id", 1.0).isEmpty()
