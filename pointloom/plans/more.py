"""Further registered queries: appends and builders, the vertex stage, branches of predicates, constants, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vector as v
from ..operators import boxes, catalog, events, joins, moments
from ..sources import formats
from ..streaming import events as live
from .registry import BOX, XYZ, E, P, R, S, V, W, _sql_triangle, named, points, query, r, spread, stream, xyz

# --- appends and builders


@query(f"WITH a AS (SELECT idx, x, y, z FROM {XYZ} UNION ALL SELECT idx + (SELECT max(idx) + 1 FROM {XYZ}), CASE WHEN idx % 5 = 0 THEN 'nan'::DOUBLE WHEN idx % 7 = 0 THEN 4e36 ELSE 2 * x END, 2 * y, 2 * z FROM {XYZ}), ok AS (SELECT * FROM a WHERE x < 3.402823466e36) SELECT (SELECT count(*) FROM a) AS rows, (SELECT max(idx) FROM a) AS last, count(*) AS n, {', '.join(f'{R(f'{m}({a})')} AS {m}{a}' for m in ('min', 'max') for a in 'xyz')} FROM ok")
def a23_append_points(spark, sf_dir):
    """Points appended, some of them invalid: all are kept, the box is of the valid ones."""
    p = xyz(spark, sf_dir).drop("label")
    x = F.when(F.col("idx") % 5 == 0, F.lit(float("nan"))).when(F.col("idx") % 7 == 0, F.lit(4e36)).otherwise(2 * F.col("x"))
    cloud = joins.append(p, p.select("idx", x.alias("x"), (2 * F.col("y")).alias("y"), (2 * F.col("z")).alias("z")))
    whole = cloud.agg(F.count("*").alias("rows"), F.max("idx").alias("last"))  # one row
    return boxes.aabb(cloud).crossJoin(F.broadcast(whole)).select("rows", "last", "n", *[r(F.col(n)).alias(n) for n in boxes.NAMES])


@query(f"SELECT idx, {R('e0')} AS x, {R('e3')} AS nx FROM {P} UNION ALL SELECT idx + (SELECT max(idx) + 1 FROM {P}), {R('e1')}, {R('e4')} FROM {P}")
def a24_append_records(spark, sf_dir):
    """Records appended in bulk to a stored table."""
    p = points(spark, sf_dir)
    path = formats.scratch(spark)
    record = lambda a, b: p.select("idx", r(E(a)).alias("x"), r(E(b)).alias("nx"))
    record(0, 3).write.parquet(path)
    have = spark.read.parquet(path)
    joins.append(have, record(1, 4)).join(have.select("idx"), "idx", "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT idx, e0 AS u, e1 AS v, NULL::DOUBLE AS material FROM {P} UNION ALL SELECT idx + (SELECT max(idx) + 1 FROM {P}), e2, e3, label::DOUBLE FROM {P}")
def a25_append_attributes(spark, sf_dir):
    """Texture coordinates, and later ones with a material."""
    p = points(spark, sf_dir)
    return joins.append(p.select("idx", E(0).alias("u"), E(1).alias("v")), p.select("idx", E(2).alias("u"), E(3).alias("v"), F.col("label").cast("double").alias("material")))


@query(f"SELECT 3 * idx + k AS idx, {R('CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE z END')} AS value FROM {XYZ}, (SELECT unnest([0, 1, 2]) AS k)")
def a29_flat_buffer(spark, sf_dir):
    return joins.flat(xyz(spark, sf_dir)).select("idx", r(F.col("value")).alias("value"))


@query(f"SELECT idx, {', '.join(R(x) + ' AS ' + n for x, n in (('CASE WHEN idx = 7 THEN 9 ELSE e0 END', 'x'), ('e1', 'y'), ('e2', 'z'), ('e3', 'nx'), ('e4', 'ny'), ('e5', 'nz'), ('abs(e6)', 'r'), ('abs(e7)', 'g'), ('abs(e8)', 'b')))}, (SELECT count(*) FROM {P}) AS n, true AS no_uvs FROM {P}")
def a30_mesh_builder(spark, sf_dir):
    p = points(spark, sf_dir)
    half = p.where("idx < 100")
    rest = p.where("idx >= 100").withColumn("idx", F.col("idx") - 100)
    part = lambda rows, names, columns: rows.select("idx", *[c.alias(n) for c, n in zip(columns, names, strict=True)])
    mesh = joins.Mesh(normals=part(p, ("nx", "ny", "nz"), V(3)))
    mesh.add("vertices", part(half, "xyz", V(0))).add("vertices", part(rest, "xyz", V(0))).at("vertices", 7, x=F.lit(9.0))
    mesh.put("colors", part(p, "rgb", [F.lit(0.0)] * 3)).put("colors", part(p, "rgb", [F.abs(E(i)) for i in (6, 7, 8)]))
    rows = mesh.vertices()
    return rows.select("idx", *[r(F.col(c)).alias(c) for c in rows.columns if c != "idx"], F.lit(mesh.size("vertices")).cast("long").alias("n"), F.lit(mesh.empty("uvs")).alias("no_uvs"))


@query(f"SELECT idx, CAST(label % 3 AS BIGINT) AS label FROM {XYZ}")
def l5_labeler(spark, sf_dir):
    """A labeler of batches in its slot."""

    def labeler(frames):
        for f in frames:
            yield f.assign(label=(f["label"] % 3).astype("int64"))[["idx", "label"]]

    return joins.label(xyz(spark, sf_dir), labeler)


# --- projections and vectors


@query(f"SELECT idx, {', '.join(f'{R(f'abs(e{i})')} AS {c}' for i, c in enumerate('rgb'))}, 1.0::DOUBLE AS a FROM {P}")
def b7_instance_colour(spark, sf_dir):
    return points(spark, sf_dir).select("idx", joins.instance_colour(tuple(r(F.abs(E(i))) for i in range(3))).alias("c")).select("idx", "c.*")


_WORLD = ["(2 * e0 + e6)", "(0.5 * e1 + e7)", "(4 * e2 + e8)"]


@query(f"SELECT idx, {', '.join(f'{R(w)} AS w{a}' for w, a in zip(_WORLD, 'xyz', strict=True))}, {R('e3 / 2')} AS nx, {R('e4 / 0.5')} AS ny, {R('e5 / 4')} AS nz, {R(f'1.5 * ({_WORLD[0]} - 1)')} AS cx, {R(f'1.5 * {_WORLD[1]}')} AS cy, {R(f'-1.02 * ({_WORLD[2]} - 3) - 0.2')} AS cz, {R(f'3 - {_WORLD[2]}')} AS cw FROM {P}")
def b9_vertex_stage(spark, sf_dir):
    """An uneven scale and a translation, a view that moves back, a perspective."""
    lit = lambda rows: [[c if not isinstance(c, float | int) else F.lit(float(c)) for c in row] for row in rows]
    model = lit([[2, 0, 0, E(6)], [0, 0.5, 0, E(7)], [0, 0, 4, E(8)], [0, 0, 0, 1]])
    view = lit([[1, 0, 0, -1], [0, 1, 0, 0], [0, 0, 1, -3], [0, 0, 0, 1]])
    projection = lit([[1.5, 0, 0, 0], [0, 1.5, 0, 0], [0, 0, -1.02, -0.2], [0, 0, -1, 0]])
    world, normal, clip = joins.vertex_stage(model, view, projection, V(0), V(3))
    return points(spark, sf_dir).select("idx", *named(spread("w", world) | spread("n", normal) | spread("c", clip)))


@query(f"SELECT label, {', '.join(f'{R(x)} AS {n}' for n, x in (('ax', 'least(minx, -2)'), ('ay', 'miny'), ('bx', 'maxx'), ('by', '7::DOUBLE'), ('cx', '1.5::DOUBLE'), ('cy', 'miny'), ('cz', '2.5::DOUBLE'), ('dx', 'minx'), ('dy', '9::DOUBLE'), ('dz', 'minz')))} FROM {BOX}")
def e6_box_setters(spark, sf_dir):
    b = boxes.columns()
    low = boxes.with_min(b, (F.least(b[0], F.lit(-2.0)), b[1], b[2]))
    high = boxes.with_max(b, v.vec(b[3], 7, b[5]))
    corner = boxes.with_corner(b, 5, (F.lit(1.5), b[1], F.lit(2.5)))  # high x, low y, high z
    other = boxes.with_corner(b, 2, (b[0], F.lit(9.0), b[2]))  # low x, high y, low z
    out = {"ax": low[0], "ay": low[1], "bx": high[3], "by": high[4], "cx": corner[3], "cy": corner[1], "cz": corner[5], "dx": other[0], "dy": other[4], "dz": other[2]}
    return boxes.aabb(xyz(spark, sf_dir), "label").select("label", *named(out))


@query(f"WITH m AS (SELECT label, {', '.join(f'avg({p[0]} * {p[1]}) AS {p}' for p in moments.PAIRS)} FROM {XYZ} GROUP BY label) SELECT label, {', '.join(f'{R(x)} AS {n}' for n, x in (('v0', 'xx'), ('v1', 'yy'), ('v2', 'zz'), ('e1x', 'xx'), ('e1y', '0::DOUBLE'), ('e2x', 'xy'), ('e2y', 'yy'), ('e2z', '0::DOUBLE'), ('e3x', 'xz'), ('e3y', 'yz'), ('e3z', 'zz')))} FROM m")
def e10_reproduced_axes(spark, sf_dir):
    a = moments.axes(moments.second_moments(xyz(spark, sf_dir), "label"))
    out = {f"v{i}": F.col(f"eigenvalues.{c}") for i, c in enumerate("xyz")} | {f"e{k}{c}": F.col(f"e{k}.{c}") for k in (1, 2, 3) for c in "xyz" if (k, c) != (1, "z")}
    return a.select("label", *named(out))


_UNIT = {"one": (1, 1, 1, 1), "x": (1, 0, 0, 0), "y": (0, 1, 0, 0), "z": (0, 0, 1, 0), "w": (0, 0, 0, 1)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{c}::DOUBLE' for c in u)})" for k, u in _UNIT.items()) + ", ('pi', pi(), radians(1), degrees(1), 0::DOUBLE)) t(name, x, y, z, w)")
def i25_constants(spark, sf_dir):
    row = lambda k, cs: spark.range(1).select(F.lit(k).alias("name"), *[c.alias(n) for c, n in zip(cs, "xyzw", strict=True)])
    out = row("pi", v.vec(v.PI, v.DEG2RAD, v.RAD2DEG, 0))
    for k in _UNIT:
        out = out.union(row(k, v.unit(k)))
    return out


@query("SELECT r_name, " + ", ".join(f"CASE r_regionkey WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS {n}{c}" for n, cs in (("p", "xy"), ("q", "xyzw")) for c in cs) + " FROM region")
def i6_keywords(spark, sf_dir):
    """Vectors of 2 and of 4 components; words that they don't know are zeros."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("ONE", "Zero", "half", "0.25", "red")]), F.col("r_regionkey") + 1)
    out = spread("p", v.keyword(words, 2)) | spread("q", v.keyword(words, 4))
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", *[c.alias(n) for n, c in out.items()])


@query(f"SELECT event_id, printf('frame %d : %.3f ms', event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER {W}, 0) / 1000.0) AS line FROM {S}")
def i12_elapsed(spark, sf_dir):
    e = events.last_known(stream(spark, sf_dir), F.lit(0.0), "zero").withColumn("before", F.lag("ts").over(events._over()))
    return e.select("event_id", text.elapsed(F.coalesce("before", "ts"), F.col("ts"), F.lit("frame"), F.col("event_id")).alias("line"))


@query("SELECT count(*) AS n, true AS recent FROM region")
def i10_now(spark, sf_dir):
    """Rows are read after the epoch and the clock doesn't stand still within a century."""
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("t", text.now())
    return rows.agg(F.count("*").alias("n"), F.min(F.col("t").between("2020-01-01", "2120-01-01")).alias("recent"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) AS word FROM part) GROUP BY word")
def a14_words(spark, sf_dir):
    return text.words(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_retailprice AS price, -p_retailprice * 100 AS scaled, 0.0::DOUBLE AS none, CAST(NULL AS DOUBLE) AS missing FROM part")
def i4_parse_numbers(spark, sf_dir):
    price = F.col("p_retailprice").cast("double")
    shown = F.format_string("%s", price.cast("string"))
    out = [text.to_float(F.concat(F.lit("  "), shown, F.lit("abc"))).alias("price"), text.to_float(F.concat(F.lit("-"), shown, F.lit("e2;"))).alias("scaled"), text.to_float_or_zero(F.lit("abc")).alias("none"), text.to_float(F.lit("")).alias("missing")]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *out)


# --- predicates and joins

_ODD_X = "(CASE WHEN idx % 5 = 0 THEN 'nan'::DOUBLE WHEN idx % 7 = 0 THEN 4e36 ELSE e0 END)"


@query(f"SELECT idx, {_ODD_X} < 3.402823466e36 AS ok FROM {P}")
def c1_valid(spark, sf_dir):
    x = F.when(F.col("idx") % 5 == 0, F.lit(float("nan"))).when(F.col("idx") % 7 == 0, F.lit(4e36)).otherwise(E(0))
    return points(spark, sf_dir).select("idx", v.valid((x, E(1), E(2))).alias("ok"))


_LONG = "(SELECT idx, " + ", ".join(f"{a} - {h} AS min{a}, {a} + {h} AS max{a}" for a, h in (("x", "(CASE WHEN idx % 2 = 0 THEN 0.2 ELSE 0.01 END)"), ("y", "(CASE WHEN idx % 2 = 0 THEN 0.01 ELSE 0.2 END)"), ("z", "0.05"))) + f" FROM {XYZ})"


def _sql_corner_in(a: str, b: str) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"{b}.{'max' if k >> i & 1 else 'min'}{c} BETWEEN {a}.min{c} AND {a}.max{c}" for i, c in enumerate("xyz")) + ")" for k in range(8)) + ")"


@query(f"SELECT l.idx AS a, r.idx AS b FROM {_LONG} l JOIN {_LONG} r ON l.idx < r.idx AND ({_sql_corner_in('l', 'r')} OR {_sql_corner_in('r', 'l')})")
def c6_reproduced_overlap(spark, sf_dir):
    """Long boxes across each other: those that cross without a corner inside aren't found."""
    even = F.col("idx") % 2 == 0
    half = {"x": F.when(even, 0.2).otherwise(0.01), "y": F.when(even, 0.01).otherwise(0.2), "z": F.lit(0.05)}
    p = xyz(spark, sf_dir)
    b = p.select("idx", *[(F.col(a) - h).alias("min" + a) for a, h in half.items()], *[(F.col(a) + h).alias("max" + a) for a, h in half.items()])
    return boxes.boxes_with_boxes(b, "idx", 0.2, exact=False)


_MID = [f"((b.min{a} + b.max{a}) * 0.5)" for a in "xyz"]
_HALF = [f"(b.max{a} - (b.min{a} + b.max{a}) * 0.5)" for a in "xyz"]
_SMALL = "(SELECT label, " + ", ".join(f"min{a} * 0.4 AS min{a}, max{a} * 0.4 AS max{a}" for a in "xyz") + f" FROM {BOX})"
_MEET = " AND ".join(f"b.min{a} <= greatest(e{i}, e{i + 3}, e{i + 6}) AND least(e{i}, e{i + 3}, e{i + 6}) <= b.max{a}" for i, a in enumerate("xyz"))


@query(f"SELECT b.label AS box, p.idx AS triangle FROM {_SMALL} b JOIN {P} p ON {_MEET} WHERE {_sql_triangle(_MID, _HALF)}")
def d7_boxes_with_triangles(spark, sf_dir):
    b = boxes.aabb(xyz(spark, sf_dir), "label").select(F.col("label").alias("box"), *[(F.col(n) * 0.4).alias(n) for n in boxes.NAMES])
    t = points(spark, sf_dir).select(F.col("idx").alias("triangle"), *[E(3 * k + i).alias(f"{a}{k}") for k in range(3) for i, a in enumerate("xyz")])
    return boxes.boxes_with_triangles(b, t, 0.25)


@query("SELECT p_brand AS shader, list_sort(list(p_partkey)) AS ids FROM part WHERE p_size % 4 <> 0 GROUP BY p_brand")
def c8_without_shader(spark, sf_dir):
    """Renderables whose shader is null are in no group."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return joins.by_shader(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("shader")))


@query("SELECT s_nationkey, list(s_suppkey ORDER BY s_suppkey) AS keys, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY s_nationkey")
def g3_ordered_map(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = catalog.ordered_map(s, "s_nationkey", "s_suppkey", "s_name")
    return rows.select("s_nationkey", F.transform("entries", lambda e: e["key"]).alias("keys"), F.transform("entries", lambda e: e["value"]).alias("names"))


@query("SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('a', 'd'), ('b', 'c'), ('b', 'a'), ('b', 'd'), ('c', 'a'), ('c', 'b'), ('c', 'd')) t(base, derived)")
def m5_registered_cycle(spark, sf_dir):
    """Registered edges, one of them twice, that make a cycle."""
    edges = spark.createDataFrame([("a", "b")], "base string, derived string")
    for base, derived in (("b", "c"), ("c", "a"), ("c", "d"), ("c", "d")):
        edges = catalog.register(edges, base, derived)
    return catalog.closure(edges)


# --- events and streams


@query(f"SELECT event_id, CAST(row_number() OVER {W} - 1 AS INT) AS at, lag(value) OVER {W} AS previous, lead(value) OVER {W} AS next FROM {S}")
def f7_history(spark, sf_dir):
    return events.history(stream(spark, sf_dir), "value").select("event_id", "at", "previous", "next")


@query(f"SELECT event_id, {R('value - coalesce(lag(value) OVER w, 0)')} AS dx FROM {S} WHERE event_type IN ('view', 'click') WINDOW w AS {W} QUALIFY event_type = 'view'")
def f1_dragged(spark, sf_dir):
    """Steps of moves (views) from the last move or press (click)."""
    kind = F.when(F.col("event_type") == "view", "move").otherwise("press")
    e = stream(spark, sf_dir).where("event_type in ('view', 'click')").select("session", "ts", "event_id", kind.alias("kind"), F.col("value").alias("x"), F.col("value").alias("y"))
    return events.dragged(e).where("kind = 'move'").select("event_id", r(F.col("dx")).alias("dx"))


_STEP = "CASE WHEN event_type = 'purchase' AND NOT (event_id % 3 = 0) THEN CASE WHEN value > 50 THEN log10(0.9) WHEN value < 50 THEN log10(1.1) ELSE 0 END ELSE 0 END"


def _replayed(spark, sf_dir) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return live.replay(spark, f"{sf_dir}/events*.parquet", schema)


def _run(spark, rows: DataFrame) -> DataFrame:
    """What a stream appends up to its end, as a stored table."""
    path = formats.scratch(spark)
    job = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path + "-state").option("path", path).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query(f"SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS last_value, row_number() OVER {W} AS n FROM {S}")
def k1_replayed_state(spark, sf_dir):
    e = _replayed(spark, sf_dir)
    return _run(spark, live.last_known(e, "user_id", "value")).select("event_id", "last_value", "n")


@query("SELECT event_id, CAST(receiver_id AS BIGINT) AS receiver_id FROM events JOIN (VALUES ('click', 1), ('view', 2), ('click', 3)) t(event_type, receiver_id) USING (event_type)")
def k2_stream_dispatch(spark, sf_dir):
    subs = spark.createDataFrame([("click", 1), ("view", 2), ("click", 3), ("click", 3)], "event_type string, receiver_id long")
    return _run(spark, live.dispatch(_replayed(spark, sf_dir), subs).select("event_id", "receiver_id"))


@query(
    f"SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0) AS x, "
    + ", ".join(f"coalesce(last_value(CASE WHEN event_id % 3 = {k} AND event_type IN ('click', 'signup') THEN event_type = 'click' END IGNORE NULLS) OVER w, false) AS {n}" for k, n in enumerate(("left", "right", "middle")))
    + f", round(log10(5) + sum({_STEP}) OVER w, 5) + 0.0 AS radius_log10 FROM {S} WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def k4_manipulator_state(spark, sf_dir):
    """Position, buttons and radius after every event of a session, kept from micro-batch to micro-batch."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "move"), ("click", "press"), ("signup", "release"), ("purchase", "wheel")) for x in pair]), F.col("event_type"))
    e = _replayed(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("ts"), "event_id", kind.alias("kind"), F.col("value").alias("x"), (100 - F.col("value")).alias("y"), (F.col("event_id") % 3).cast("int").alias("button"), (F.col("value") - 50).alias("dy"), F.lit(None).cast("string").alias("key"), (F.col("event_id") % 3 == 0).alias("shift"))
    return _run(spark, live.manipulator(e)).select("event_id", "x", "left", "right", "middle", F.round(F.log10("radius"), 5).alias("radius_log10"))
