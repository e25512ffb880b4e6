"""Bounding boxes: aggregates, derived values, predicates and joins.

A box is a tuple of six Columns (minx, miny, minz, maxx, maxy, maxz)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v

NAMES = ("minx", "miny", "minz", "maxx", "maxy", "maxz")
Box = tuple[Column, ...]


def columns(prefix: str = "") -> Box:
    return tuple(F.col(prefix + n) for n in NAMES)


def aabb(points: DataFrame, *by: str) -> DataFrame:
    """The box of the valid points (x, y, z) of each group, and their number; null where there are none."""
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    ok = v.valid(xyz)
    lows = [F.min(F.when(ok, c)).alias(n) for c, n in zip(xyz, NAMES[:3], strict=True)]
    highs = [F.max(F.when(ok, c)).alias(n) for c, n in zip(xyz, NAMES[3:], strict=True)]
    return points.groupBy(*by).agg(*lows, *highs, F.count(F.when(ok, F.lit(1))).alias("n"))


def centre(b: Box) -> v.Vector:
    return tuple((b[i] + b[i + 3]) * 0.5 for i in range(3))


def extents(b: Box) -> v.Vector:
    return v.sub(b[3:], centre(b))


def lengths(b: Box) -> v.Vector:
    return v.sub(b[3:], b[:3])


def corners(b: Box) -> list[v.Vector]:
    """All eight, z fastest."""
    return [tuple(b[i + 3 * k] for i, k in enumerate(pick)) for pick in product((0, 1), repeat=3)]


def with_min(b: Box, p: v.Vector) -> Box:
    return (*p, *b[3:])


def with_max(b: Box, p: v.Vector) -> Box:
    return (*b[:3], *p)


def with_corner(b: Box, k: int, p: v.Vector) -> Box:
    """The box with its k-th corner, counted as in corners(), moved to p."""
    out = list(b)
    for i, side in enumerate(list(product((0, 1), repeat=3))[k]):
        out[i + 3 * side] = p[i]
    return tuple(out)


def expand_to(b: Box, p: v.Vector) -> Box:
    return tuple(F.least(b[i], p[i]) for i in range(3)) + tuple(F.greatest(b[i + 3], p[i]) for i in range(3))


def expand_by(b: Box, size) -> Box:
    """Both ends of the diagonal, moved outwards along it; the second step uses the box as the first left it."""
    move = v.mul(v.normalize(v.sub(b[3:], centre(b))), v.col(size))
    b = expand_to(b, v.add(b[3:], move))
    return expand_to(b, v.sub(b[:3], move))


def expand_z(b: Box, by) -> Box:
    return (b[0], b[1], b[2] - v.col(by), b[3], b[4], b[5] + v.col(by))


def contains(b: Box, p: v.Vector) -> Column:
    """Inclusive."""
    out = p[0].between(b[0], b[3])
    for i in (1, 2):
        out = out & p[i].between(b[i], b[i + 3])
    return out


def intersects(a: Box, b: Box) -> Column:
    """As reproduced: a corner of one lies in the other; boxes that cross without that don't count."""
    out = F.lit(False)
    for c in corners(b):
        out = out | contains(a, c)
    for c in corners(a):
        out = out | contains(b, c)
    return out


def intersects_exact(a: Box, b: Box) -> Column:
    out = F.lit(True)
    for i in range(3):
        out = out & (a[i] <= b[i + 3]) & (b[i] <= a[i + 3])
    return out


def _separated(axis: v.Vector, half: v.Vector, points: list[v.Vector], exact: bool) -> Column:
    """Whether the points' projections lie outside the box's on this axis, by more than the float epsilon."""
    p = [v.dot(x, axis) for x in points]
    r = v.dot(half, tuple(F.abs(c) for c in axis))
    return F.greatest(-F.greatest(*p), F.least(*p)) > r + v.FLOAT_EPSILON


def intersects_triangle(b: Box, t0: v.Vector, t1: v.Vector, t2: v.Vector, exact: bool = False) -> Column:
    """Separating-axis test: nine edge axes, the box's axes, the triangle's plane.

    As reproduced, the box's axes part only triangles beyond the upper side; exact parts both."""
    mid, half = centre(b), extents(b)
    points = [v.sub(t, mid) for t in (t0, t1, t2)]
    edges = [v.sub(t1, t0), v.sub(t2, t1), v.sub(t0, t2)]
    unit = [v.vec(*[float(i == k) for i in range(3)]) for k in range(3)]
    apart = F.lit(False)
    for k in range(3):
        for e in edges:
            apart = apart | _separated(v.cross(unit[k], e), half, points, exact)
    for k in range(3):
        low, high = F.least(*[p[k] for p in points]), F.greatest(*[p[k] for p in points])
        apart = apart | ((low > half[k]) & ((high + half[k] > v.FLOAT_EPSILON) | (low - half[k] > v.FLOAT_EPSILON)))
        if exact:
            apart = apart | (high < -half[k] - v.FLOAT_EPSILON)
    normal = v.cross(edges[0], edges[1])
    apart = apart | (F.abs(v.dot(normal, points[0])) > v.dot(half, tuple(F.abs(c) for c in normal)) + v.FLOAT_EPSILON)
    return ~apart


#: Coarsest level of the grids; there the cells are two an axis, split at 0.
TOP = 60


def _bounds(b: Box) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(b, NAMES, strict=True)])


def _levelled(df: DataFrame, b: Box, size: float) -> DataFrame:
    """With _b, the bounds, and _own, the level whose cells, of size * 2**level, are no shorter than the longest
    side; rows with a null or NaN bound, or one side below the other, meet nothing and go."""
    longest = F.greatest(*[F.col(f"_b.{h}") - F.col(f"_b.{low}") for low, h in zip(NAMES[:3], NAMES[3:], strict=True)])
    level = F.when(longest > size, F.least(F.ceil(F.log2(longest / size)), F.lit(TOP))).otherwise(0).cast("int")
    df = df.withColumn("_b", _bounds(b))
    for low, high in zip(NAMES[:3], NAMES[3:], strict=True):
        df = df.where(~F.isnan(f"_b.{low}") & ~F.isnan(f"_b.{high}") & (F.col(f"_b.{low}") <= F.col(f"_b.{high}")))
    return df.withColumn("_own", level)


def _cell(c: Column, size: float) -> Column:
    at = F.floor(c / (F.lit(float(size)) * F.pow(F.lit(2.0), "_level"))).cast("long")
    return F.when(F.col("_level") < TOP, at).otherwise(F.when(c < 0, -1).otherwise(0).cast("long"))


def _in_cells(df: DataFrame, size: float) -> DataFrame:
    """Dealt to the cells of _level that the bounds cover; at the own level or a coarser one at most two an axis."""
    for low, high in zip(NAMES[:3], NAMES[3:], strict=True):
        df = df.withColumn(f"_{low}", F.explode(F.sequence(_cell(F.col(f"_b.{low}"), size), _cell(F.col(f"_b.{high}"), size))))
    return df


def _met(home: DataFrame, guests: DataFrame, size: float, coarser: bool = False) -> DataFrame:
    """Pairs whose bounds overlap: rows of home in the cells of their own level, guests in those of every level
    that home has from their own (or, coarser, the next) up. A pair is taken in the cell where the
    intersection begins, so it is found once without a distinct. Guests' columns must differ from home's."""
    levels = home.agg(F.collect_set("_own").alias("_levels"))  # one row of at most TOP + 1 numbers
    reach = F.filter("_levels", lambda x: x > F.col("_own") if coarser else x >= F.col("_own"))
    left = _in_cells(home.withColumn("_level", F.col("_own")), size)
    right = _in_cells(guests.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode(reach)).drop("_levels"), size)
    keys = ["_level", *[f"_{n}" for n in NAMES[:3]]]
    pairs = left.withColumnRenamed("_b", "_l").withColumnRenamed("_own", "_l_own").join(right.withColumnRenamed("_b", "_r").withColumnRenamed("_own", "_r_own"), keys)
    for low, high in zip(NAMES[:3], NAMES[3:], strict=True):
        begin, end = F.greatest(f"_l.{low}", f"_r.{low}"), F.least(f"_l.{high}", f"_r.{high}")
        pairs = pairs.where((begin <= end) & (F.col(f"_{low}") == _cell(begin, size)))
    return pairs


def boxes_with_points(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Pairs of a box and a point in it, by an equi-join on grid cells, of which `size` is the finest.

    A box is dealt to at most eight cells, of the level that fits its longest side; a point has one cell at each
    level that boxes have. The join is by hash of the cell, so adaptive execution splits a dense cell."""
    xyz = tuple(F.col(a) for a in "xyz")
    found = _met(_levelled(boxes, columns(), size), _levelled(points.where(v.valid(xyz)), xyz + xyz, size), size)
    return found.select(*boxes.columns, *points.columns)


def boxes_with_boxes(boxes: DataFrame, key: str, size: float, exact: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of overlapping boxes, by grid cells as above; a box is dealt to its own level and to the
    coarser ones, at most eight cells each. The test as reproduced is a search of corners, see _corners_in_boxes."""
    own = _levelled(boxes, columns(), size)
    if not exact:
        return _corners_in_boxes(own, key, size)
    pairs = _met(own.select(F.col(key).alias("_a"), "_b", "_own"), own.select(F.col(key).alias("_c"), "_b", "_own"), size)
    pairs = pairs.where((F.col("_a") != F.col("_c")) & ((F.col("_r_own") < F.col("_l_own")) | (F.col("_a") < F.col("_c"))))
    return pairs.where(intersects_exact(columns("_l."), columns("_r."))).select(F.least("_a", "_c").alias("a"), F.greatest("_a", "_c").alias("b"))


#: Boxes of a crowded cell that a task holds at a time, and candidates that it tests at a time.
HELD, TESTED = 8192, 1 << 20


def _corners_in_boxes(own: DataFrame, key: str, size: float) -> DataFrame:
    """Pairs (a, b), a < b, of levelled boxes of which one has a corner in the other.

    Boxes are dealt to the cells of their own level, and all boxes' corners to one cell each at every level that occurs. Boxes
    that are long in one axis and narrow in another share their cells with most others, so a cell's pairs aren't joined
    and then tested: its boxes are split into parts of about HELD, the corners stream past each part, and ranges of sorted bounds
    in the axis where a box meets fewest lead to the candidates. A pair is taken in the cell of the first corner inside."""
    from pyspark.sql.types import StructField, StructType

    own = own.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "_b", "_own")
    cells, ends = ["_level", *[f"_{n}" for n in NAMES[:3]]], list(zip(NAMES[:3], NAMES[3:], strict=True))
    home = _in_cells(own.withColumn("_level", F.col("_own")), size)
    levels = own.agg(F.collect_set("_own").alias("_levels"))  # one row of at most TOP + 1 numbers
    guests = own.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    for low, high in ends:
        guests = guests.withColumn(f"_{low}", F.explode(F.array_distinct(F.array(_cell(F.col(f"_b.{low}"), size), _cell(F.col(f"_b.{high}"), size)))))
    # a bit for each bound that lies in this cell's range
    at = sum((F.when(_cell(F.col(f"_b.{n}"), size) == F.col(f"_{NAMES[i % 3]}"), 1 << i).otherwise(0) for i, n in enumerate(NAMES)), F.lit(0))
    parts = home.groupBy(*cells).agg(F.ceil(F.count("*") / HELD).cast("int").alias("_parts"))
    home = home.join(parts, cells).withColumn("_part", F.pmod(F.xxhash64("_key", "_b"), "_parts").cast("int")).withColumn("_at", F.lit(-1))
    guests = guests.join(parts, cells).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_at", at)
    group = [*cells, "_part"]
    rows = home.select(*group, "_at", "_key", "_b.*").unionByName(guests.select(*group, "_at", "_key", "_b.*"))
    context = own.sparkSession.sparkContext
    n = max(4 * context.defaultParallelism, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, *group).sortWithinPartitions(*group, "_at")  # a group's boxes come first

    kind = own.schema["_key"].dataType
    return dealt.mapInArrow(_corner_search(group), StructType([StructField("a", kind), StructField("b", kind)]))


def _corner_search(group: list[str]):
    """For mapInArrow over sorted groups, each of boxes (_at -1) and then of corners' boxes. Its functions are nested so that
    they go to the workers by value."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def between(x, low, high):
        return (low <= x) & (x <= high)

    def candidates(home, home_group, guests, guest_group, at):
        """Index pairs (i, j), at most TESTED or one box's own at a time, of a box of home (six rows of bounds) and a guest of
        its group whose first corner inside the box has all its bounds among those marked in at."""
        spans = []  # for each bound: guests in order, and where each box's range of them begins and ends
        for k in range(6):
            marked = np.flatnonzero(at[k])
            values, rank = np.unique(guests[k][marked], return_inverse=True)
            width = len(values) + 1
            rank = guest_group[marked] * width + rank
            order = np.argsort(rank, kind="stable")
            edges = [np.searchsorted(rank[order], home_group * width + np.searchsorted(values, home[k % 3 + d], side)) for d, side in ((0, "left"), (3, "right"))]
            spans.append((marked[order], *edges))
        counts = np.stack([sum(spans[i][2] - spans[i][1] for i in (k, k + 3)) for k in range(3)])
        best, totals = counts.argmin(axis=0), counts.sum(axis=1)
        for end in range(6):
            k = end % 3
            rest = sorted({0, 1, 2} - {k}, key=lambda x: totals[x])
            order, begin, stop = spans[end]
            mine = np.flatnonzero((best == k) & (stop > begin))
            upto = np.cumsum(stop[mine] - begin[mine])
            first = 0
            while first < len(mine):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TESTED, "right")))
                box = mine[first:last]
                n = stop[box] - begin[box]
                i = np.repeat(box, n)
                j = order[np.arange(len(i)) + np.repeat(begin[box] - np.cumsum(n) + n, n)]
                if end > 2:  # the lower bound comes first, where it is inside
                    ok = guests[k][j] < home[k][i]
                    i, j = i[ok], j[ok]
                for x in rest:
                    low, high = home[x][i], home[x + 3][i]
                    ok = np.where(between(guests[x][j], low, high), at[x][j], between(guests[x + 3][j], low, high) & at[x + 3][j])
                    i, j = i[ok], j[ok]
                if len(i):
                    yield i, j
                first = last

    def meet(table):
        new = np.zeros(len(table), bool)
        for c in group:
            x = table[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        number, bits = np.cumsum(new), table["_at"].to_numpy()
        own, others = np.flatnonzero(bits < 0), np.flatnonzero(bits >= 0)
        b, keys = np.stack([table[n].to_numpy() for n in NAMES]), table["_key"].combine_chunks()
        home, guests = b[:, own], b[:, others]
        at = [(bits[others] >> i & 1).astype(bool) for i in range(6)]
        for i, j in candidates(home, number[own], guests, number[others], at):
            both = np.ones(len(i), bool)  # whether the box has a corner in the guest, too
            for k in range(3):
                low, high = guests[k][j], guests[k + 3][j]
                both &= between(home[k][i], low, high) | between(home[k + 3][i], low, high)
            a, c = keys.take(pa.array(own[i])), keys.take(pa.array(others[j]))
            less = pc.less(a, c)
            keep = pc.or_(less, pc.and_(pc.greater(a, c), pa.array(~both)))
            yield pa.RecordBatch.from_arrays([pc.if_else(less, a, c), pc.if_else(less, c, a)], names=["a", "b"]).filter(keep)
        return table.take(pa.array(own[number[own] == number[-1]]))

    def run(batches):
        held = None  # the boxes of the group that the last batch ended in
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = yield from meet(table if held is None else pa.concat_tables([held, table]))

    return run


def boxes_with_triangles(boxes: DataFrame, triangles: DataFrame, size: float, exact: bool = False) -> DataFrame:
    """(box, triangle) for each box (box, minx .. maxz) and triangle (triangle, x0, y0, z0 .. z2) that overlap.

    Pairs whose bounds meet are found by grid cells as above: the larger one at its own level, the other at the
    levels of those. The test as reproduced also takes triangles that lie below the box in an axis
    but pass the other tests; those are found only as far as the bounds meet."""
    corner = lambda k: tuple(F.col(f"{a}{k}") for a in "xyz")
    sides = [[F.col(f"{a}{k}") for k in range(3)] for a in "xyz"]
    t = _levelled(triangles, tuple(F.least(*c) for c in sides) + tuple(F.greatest(*c) for c in sides), size)
    t = t.select("triangle", *[f"{a}{k}" for a in "xyz" for k in range(3)], "_b", "_own")
    b = _levelled(boxes, columns(), size).select("box", *NAMES, "_b", "_own")
    names = ["box", *NAMES, "triangle", *[f"{a}{k}" for a in "xyz" for k in range(3)]]
    pairs = _met(b, t, size).select(*names).unionByName(_met(t, b, size, coarser=True).select(*names))
    return pairs.where(intersects_triangle(columns(), corner(0), corner(1), corner(2), exact)).select("box", "triangle")


def wireframe(b: Box) -> Column:
    """The 12 edges of a box as 24 points, in an array."""
    c = corners(b)
    ends = [(i, i | bit) for bit in (1, 2, 4) for i in range(8) if not i & bit]
    return F.array(*[v.pack(c[k]) for pair in ends for k in pair])
