"""All registered queries of the library and their SQL.

Points are the first components of `embeddings` (position 0-2, normal 3-5, more as needed), groups
their label; the event stream is `events`, its sessions the users. Doubles are rounded to six
decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as m
from ..functions import quaternion as q
from ..functions import text
from ..functions import vector as v
from ..operators import boxes, catalog, events, generators, joins, moments
from ..sources import formats

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files, more  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: _SQL[k] for k in queries() if k in _SQL}


# --- shared shapes, in both languages


def r(c: Column) -> Column:
    return F.round(c, 6)


def R(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def points(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("idx"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)])


def xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, 3).select("idx", "label", *[F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")])


def E(i: int) -> Column:
    return F.col(f"e{i}")


def V(i: int, n: int = 3) -> v.Vector:
    return tuple(E(i + k) for k in range(n))


P = "(SELECT vec_id AS idx, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(12)) + " FROM embeddings)"
XYZ = "(SELECT vec_id AS idx, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
BOX = f"(SELECT label, min(x) AS minx, min(y) AS miny, min(z) AS minz, max(x) AS maxx, max(y) AS maxy, max(z) AS maxz, count(*) AS n FROM {XYZ} GROUP BY label)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


S = "(SELECT user_id AS session, ts, event_id, event_type, value FROM events)"
W = "(PARTITION BY session ORDER BY ts, event_id)"


def named(out: dict[str, Column]) -> list[Column]:
    return [r(c).alias(k) for k, c in out.items()]


def spread(prefix: str, a: v.Vector, names: str = "xyzw") -> dict[str, Column]:
    return {prefix + n: c for n, c in zip(names, a, strict=False)}


def cell(m_: list, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{i}{j}": c for i, row in enumerate(m_) for j, c in enumerate(row)}


# --- boxes and moments


@query(f"SELECT label, {', '.join(f'{R(n)} AS {n}' for n in boxes.NAMES)}, n, {', '.join(f'{R(f'(min{a} + max{a}) * 0.5')} AS c{a}' for a in 'xyz')} FROM {BOX}")
def e1_aabb_by_group(spark, sf_dir):
    b = boxes.aabb(xyz(spark, sf_dir), "label")
    return b.select("label", *[r(F.col(n)).alias(n) for n in boxes.NAMES], "n", *named(spread("c", boxes.centre(boxes.columns()))))


@query(f"SELECT label, {', '.join(f'{R(f'max{a} - (min{a} + max{a}) * 0.5')} AS h{a}, {R(f'max{a} - min{a}')} AS l{a}' for a in 'xyz')}, {R('minz - 0.25')} AS lowz, {R('maxz + 0.25')} AS highz FROM {BOX}")
def e3_box_extents(spark, sf_dir):
    b = boxes.columns()
    z = boxes.expand_z(b, 0.25)
    return boxes.aabb(xyz(spark, sf_dir), "label").select("label", *named(spread("h", boxes.extents(b)) | spread("l", boxes.lengths(b)) | {"lowz": z[2], "highz": z[5]}))


@query(f"SELECT label, {', '.join(f'{R(f'least(min{a}, 0.9)')} AS min{a}, {R(f'greatest(max{a}, 0.9)')} AS max{a}' for a in 'xyz')} FROM {BOX}")
def e4_box_expand(spark, sf_dir):
    b = boxes.expand_to(boxes.columns(), v.vec(0.9, 0.9, 0.9))
    return boxes.aabb(xyz(spark, sf_dir), "label").select("label", *named(dict(zip(boxes.NAMES, b, strict=True))))


@query(f"""WITH b AS {BOX}, c AS (SELECT *, {', '.join(f'(min{a} + max{a}) * 0.5 AS c{a}' for a in 'xyz')} FROM b),
    d AS (SELECT *, sqrt({' + '.join(f'(max{a} - c{a}) * (max{a} - c{a})' for a in 'xyz')}) AS m FROM c),
    u AS (SELECT *, {', '.join(f'CASE WHEN m <> 0 THEN (max{a} - c{a}) / m ELSE 0 END AS d{a}' for a in 'xyz')} FROM d)
    SELECT label, {', '.join(f'{R(f'least(min{a}, min{a} - 2.0 * d{a})')} AS min{a}, {R(f'greatest(max{a}, max{a} + 2.0 * d{a})')} AS max{a}' for a in 'xyz')} FROM u""")
def e5_box_expand_by(spark, sf_dir):
    b = boxes.expand_by(boxes.columns(), 2.0)
    return boxes.aabb(xyz(spark, sf_dir), "label").select("label", *named(dict(zip(boxes.NAMES, b, strict=True))))


@query(f"SELECT label, {', '.join(f'{R(f'avg({a})')} AS m{a}' for a in 'xyz')}, count(*) AS n FROM {XYZ} GROUP BY label")
def e8_mean(spark, sf_dir):
    return moments.mean(xyz(spark, sf_dir), "label").select("label", *[r(F.col("m" + a)).alias("m" + a) for a in "xyz"], "n")


@query(f"SELECT idx, label, {', '.join(f'{R(f'{a} - avg({a}) OVER (PARTITION BY label)')} AS {a}' for a in 'xyz')} FROM {XYZ}")
def e9_centred(spark, sf_dir):
    return moments.centred(xyz(spark, sf_dir), "label").select("idx", "label", *[r(F.col(a)).alias(a) for a in "xyz"])


@query(f"SELECT label, {', '.join(f'{R(f'avg({p[0]} * {p[1]})')} AS {p}' for p in moments.PAIRS)} FROM {XYZ} GROUP BY label")
def e10_second_moments(spark, sf_dir):
    return moments.second_moments(xyz(spark, sf_dir), "label").select("label", *[r(F.col(p)).alias(p) for p in moments.PAIRS])


@query(f"SELECT label, {', '.join(f'{R(f'covar_pop({p[0]}, {p[1]})')} AS {p}' for p in moments.PAIRS)} FROM {XYZ} GROUP BY label")
def e10_covariance(spark, sf_dir):
    return moments.covariance(xyz(spark, sf_dir), "label").select("label", *[r(F.col(p)).alias(p) for p in moments.PAIRS])


_Q = "((xx + yy + zz) / 3)"
_P2 = f"sqrt((power(xx - {_Q}, 2) + power(yy - {_Q}, 2) + power(zz - {_Q}, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"


@query(
    f"WITH m AS (SELECT label, {', '.join(f'covar_pop({p[0]}, {p[1]}) AS {p}' for p in moments.PAIRS)} FROM {XYZ} GROUP BY label), k AS (SELECT *, {_Q} AS q, {_P2} AS p FROM m), "
    "s AS (SELECT *, (xx - q) / p AS a, xy / p AS b, xz / p AS c, (yy - q) / p AS d, yz / p AS e, (zz - q) / p AS f FROM k), "
    "t AS (SELECT *, acos(least(greatest((a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) / 2, -1), 1)) / 3 AS phi FROM s) "
    f"SELECT label, {', '.join(f'{R(f'q + 2 * p * cos(phi + 2 * pi() * {k} / 3)')} AS l{i}' for i, k in enumerate((0, 2, 1)))} FROM t"
)
def e10_principal_axes(spark, sf_dir):
    """Against the closed form for symmetric matrices of 3 rows."""
    return moments.principal_axes(moments.covariance(xyz(spark, sf_dir), "label")).select("label", *[r(F.get("values", F.lit(i))).alias(f"l{i}") for i in range(3)])


# --- scalars


def _sql_cross(a: int, b: int) -> list[str]:
    return [f"e{a + (i + 1) % 3} * e{b + (i + 2) % 3} - e{a + (i + 2) % 3} * e{b + (i + 1) % 3}" for i in range(3)]


def _sql_dot(a: int, b: int, n: int = 3) -> str:
    return "(" + " + ".join(f"e{a + i} * e{b + i}" for i in range(n)) + ")"


@query(
    f"SELECT idx, {R(_sql_dot(0, 3))} AS dot, {', '.join(f'{R(c)} AS c{a}' for a, c in zip('xyz', _sql_cross(0, 3), strict=True))}, {R(f'sqrt({_sql_dot(0, 0)})')} AS mag, "
    f"{R('sqrt((e0-e3)*(e0-e3) + (e1-e4)*(e1-e4) + (e2-e5)*(e2-e5))')} AS dist, {', '.join(f'{R(f'e{i} / sqrt({_sql_dot(0, 0)})')} AS n{a}' for i, a in enumerate('xyz'))}, "
    f"{R(f'acos(least(greatest({_sql_dot(0, 3)}, -1), 1))')} AS angle, {R(f'acos(least(greatest({_sql_dot(0, 3)} / sqrt({_sql_dot(0, 0)}) / sqrt({_sql_dot(3, 3)}), -1), 1))')} AS angle_exact, {R('greatest(e0, e1, e2)')} AS top, {R('least(e0, e1, e2)')} AS low FROM {P}"
)
def i20_vectors(spark, sf_dir):
    a, b = V(0), V(3)
    out = {"dot": v.dot(a, b)} | spread("c", v.cross(a, b)) | {"mag": v.magnitude(a), "dist": v.distance(a, b)} | spread("n", v.normalize(a))
    out |= {"angle": v.angle(a, b), "angle_exact": v.angle_exact(a, b), "top": v.greatest3(*a), "low": v.least3(*a)}
    return points(spark, sf_dir).select("idx", *named(out))


@query(f"SELECT idx, {', '.join(f'{R(f'e{i} - 1')} AS m{a}, {R(f'1 - e{i}')} AS me{a}, {R(f'CASE WHEN label <> 0 THEN e{i} / label END')} AS o{a}, {R(f'e{i} * 2 + e{i + 3} - e{i + 6} * e{i}')} AS k{a}' for i, a in enumerate('xyz'))} FROM {P}")
def i18_arithmetic(spark, sf_dir):
    a = V(0)
    out = spread("m", v.scalar_minus(1, a)) | spread("me", v.scalar_minus_exact(1, a)) | spread("o", v.scalar_over(F.col("label").cast("double"), a)) | spread("k", v.sub(v.add(v.mul(a, 2), V(3)), v.mul(V(6), a)))
    return points(spark, sf_dir).select("idx", *named(out))


@query(f"SELECT idx, {R(_sql_dot(0, 4, 4))} AS dot, {R(f'sqrt({_sql_dot(0, 0, 4)})')} AS mag, {', '.join(f'{R(f'e{i} / sqrt({_sql_dot(0, 0, 4)})')} AS n{a}, {R(f'e{i} + e{i + 4}')} AS s{a}' for i, a in enumerate('xyzw'))} FROM {P}")
def i23_vec4(spark, sf_dir):
    a, b = V(0, 4), V(4, 4)
    return points(spark, sf_dir).select("idx", *named({"dot": v.dot(a, b), "mag": v.magnitude(a)} | spread("n", v.normalize4(a)) | spread("s", v.add(a, b))))


_N = [f"(CASE WHEN idx % 4 = 0 THEN 0 ELSE e{i} END)" for i in (9, 10, 11)]  # every fourth line lies in its plane's direction
_DEN = f"((e3-e0)*{_N[0]} + (e4-e1)*{_N[1]} + (e5-e2)*{_N[2]})"
_T = f"(((e6-e0)*{_N[0]} + (e7-e1)*{_N[1]} + (e8-e2)*{_N[2]}) / nullif({_DEN}, 0))"


@query(f"SELECT idx, {_DEN} = 0 AS parallel, {', '.join(f'CASE WHEN abs({_DEN}) > 0.001 THEN round(e{i} + {_T} * (e{i + 3} - e{i}), 3) + 0.0 END AS {a}' for i, a in enumerate('xyz'))} FROM {P}")
def i26_line_plane(spark, sf_dir):
    """x, y, z are null where the lines are parallel (NaN), or so nearly that their digits mean nothing."""
    normal = tuple(F.when(F.col("idx") % 4 == 0, F.lit(0.0)).otherwise(E(i)) for i in (9, 10, 11))
    met, across = v.line_plane(V(0), V(3), V(6), normal), v.dot(v.sub(V(3), V(0)), normal)
    return points(spark, sf_dir).select("idx", F.isnan(met[0]).alias("parallel"), *[F.when(F.abs(across) > 0.001, F.round(c, 3)).alias(a) for a, c in zip("xyz", met, strict=True)])


@query(f"SELECT idx, {R('e0 + 5 * cos(radians(e4 * 90)) * sin(radians(e3 * 360))')} AS x, {R('e1 + 5 * sin(radians(e4 * 90))')} AS y, {R('e2 + 5 * cos(radians(e4 * 90)) * cos(radians(e3 * 360))')} AS z FROM {P}")
def i27_orbit_eye(spark, sf_dir):
    return points(spark, sf_dir).select("idx", *named(spread("", v.orbit_eye(V(0), 5, E(3) * 360, E(4) * 90))))


def _sql_hash(seed: str) -> str:
    s = f"(({seed}) & 4294967295)"
    s = f"xor({s}, {s} >> 13)"
    s = f"(({s} * 1540483477) & 4294967295)"
    return f"((xor({s}, {s} >> 15) & 16777215) / 16777215.0)"


@query("SELECT event_id, " + ", ".join(f"{R(_sql_hash(f'event_id * 3 + {k}'))} AS {c}" for k, c in enumerate("rgb")) + " FROM events")
def i31_hash_colour(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", *[r(c).alias(n) for n, c in zip("rgb", text.hash_colour(F.col("event_id")), strict=True)])


def _sql_rotate(w: str, u: list[str], p: list[str]) -> list[str]:
    x = lambda a, b: [f"({a[(i + 1) % 3]} * {b[(i + 2) % 3]} - {a[(i + 2) % 3]} * {b[(i + 1) % 3]})" for i in range(3)]
    once = x(u, p)
    twice = x(u, once)
    return [f"({p[i]} + 2 * ({w} * {once[i]} + {twice[i]}))" for i in range(3)]


@query(f"SELECT idx, {', '.join(f'{R(c)} AS r{a}' for a, c in zip('xyz', _sql_rotate('cos(e6 / 2)', [f'(e{i} * sin(e6 / 2))' for i in (3, 4, 5)], ['e0', 'e1', 'e2']), strict=True))}, {R('e0*e4 - e1*e5 - e2*e6 - e3*e7')} AS pw, {R('e0*e5 + e1*e4 + e2*e7 - e3*e6')} AS px, {R('e0*e6 - e1*e7 + e2*e4 + e3*e5')} AS py, {R('e0*e7 + e1*e6 - e2*e5 + e3*e4')} AS pz FROM {P}")
def i34_quaternions(spark, sf_dir):
    return points(spark, sf_dir).select("idx", *named(spread("r", q.rotate(V(0), q.about(E(6), V(3)))) | spread("p", q.product(V(0, 4), V(4, 4)), "wxyz")))


_COS = f"({_sql_dot(0, 3)} / sqrt({_sql_dot(0, 0)}) / sqrt({_sql_dot(3, 3)}))"


@query(f"SELECT idx, {', '.join(f'{R(f'CASE WHEN {_COS} > 0.9999 THEN e{i} / sqrt({_sql_dot(0, 0)}) WHEN {_COS} < -0.9999 THEN -e{i} / sqrt({_sql_dot(0, 0)}) ELSE e{i + 3} / sqrt({_sql_dot(3, 3)}) END')} AS {a}' for i, a in enumerate('xyz'))} FROM {P}")
def i36_quaternion_between(spark, sf_dir):
    """A unit vector turned by the turn from it to another is that other."""
    turned = q.rotate(v.normalize(V(0)), q.between(V(0), V(3)))
    return points(spark, sf_dir).select("idx", *named(spread("", turned)))


_M3 = [f"e{i}" if i < 6 else f"(CASE WHEN idx % 3 = 0 THEN 2 * e{i - 6} ELSE e{i} END)" for i in range(9)]  # every third matrix is singular
_D3 = "({0} * ({4}*{8} - {5}*{7}) - {1} * ({3}*{8} - {5}*{6}) + {2} * ({3}*{7} - {4}*{6}))".format(*_M3)


def _sql_inverse3(i: int, j: int) -> str:
    a, b, c, d = ((j + 1) % 3, (i + 1) % 3, (j + 2) % 3, (i + 2) % 3)
    minor = f"({_M3[3 * a + b]} * {_M3[3 * c + d]} - {_M3[3 * a + d]} * {_M3[3 * c + b]})"
    return f"CASE WHEN abs({_D3}) < 1e-12 THEN {float(i == j)}::DOUBLE WHEN abs({_D3}) > 0.0001 THEN round({minor} / {_D3}, 3) + 0.0 END"


@query(f"SELECT idx, {R(_D3)} AS det, {', '.join(f'{R(f'{_M3[3 * i]}*{_M3[j]} + {_M3[3 * i + 1]}*{_M3[3 + j]} + {_M3[3 * i + 2]}*{_M3[6 + j]}')} AS s{i}{j}, {R(_M3[3 * j + i])} AS t{i}{j}, {_sql_inverse3(i, j)} AS i{i}{j}' for i in range(3) for j in range(3))} FROM {P}")
def i38_matrix3(spark, sf_dir):
    """Determinant, square, transpose and inverse; singular matrices have the identity for inverse, and it is
    null where the determinant is too small for its digits to mean something."""
    a = [[E(3 * i + j) if i < 2 else F.when(F.col("idx") % 3 == 0, 2 * E(j)).otherwise(E(6 + j)) for j in range(3)] for i in range(3)]
    det, inverse = m.determinant(a), m.inverse(a)
    some = (F.abs(det) < 1e-12) | (F.abs(det) > 0.0001)
    inner = [F.when(some, F.round(inverse[i][j], 3)).alias(f"i{i}{j}") for i in range(3) for j in range(3)]
    return points(spark, sf_dir).select("idx", *named({"det": det} | cell(m.multiply(a, a), "s") | cell(m.transpose(a), "t")), *inner)


@query(f"SELECT idx, {', '.join(f'{R(f'e0*{s} + e{i + 3}')} AS p{a}, {R(f'e{i} * 1.5')} AS t{a}' for i, (a, s) in enumerate(zip('xyz', ('1.5', '0', '0'), strict=True)) if i == 0)}, {R('e1 * 1.5 + e4')} AS py, {R('e2 * 1.5 + e5')} AS pz, 3.375 AS det FROM {P}")
def i42_instance_transform(spark, sf_dir):
    a = m.instance(V(3), 1.5)
    p, t = m.transform_point(a, V(0)), m.transform_vector(a, V(0))
    return points(spark, sf_dir).select("idx", *named({"px": p[0], "tx": t[0], "py": p[1], "pz": p[2]}), r(m.determinant(a)).cast("decimal(4,3)").alias("det"))


@query(
    f"SELECT idx, {R('1 / (1.5 + e6)')} AS i00, {', '.join(f'{R('0::DOUBLE')} AS i0{j}' for j in (1, 2, 3))}, {', '.join(f'{float(i == j)}::DOUBLE AS i{i}{j}' for i in (1, 2, 3) for j in range(4))}, "
    f"{', '.join(f'{R(f'-e{3 + j} / ((1.5 + e6) * (1 + e6))')} AS x3{j}' for j in range(3))}, {R('1 / (1 + e6)')} AS x33 FROM {P}"
)
def i41_matrix4_inverse(spark, sf_dir):
    """The inverse as reproduced, and the last row of the exact one."""
    a = m.add(m.instance(V(3), 1.5), m.scale(m.identity(4), E(6)))
    return points(spark, sf_dir).select("idx", *named(cell(m.inverse4(a), "i") | {f"x3{j}": c for j, c in enumerate(m.inverse(a)[3])}))


@query("SELECT p_partkey, list_filter(string_split_regex(p_type, '[ _]'), lambda x: x <> '') AS parts, len(string_split(p_name, ' ')) AS n, CASE WHEN p_name = '' THEN NULL ELSE 7 END AS k, CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS BIGINT) AS brand FROM part")
def i1_split_and_parse(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.split_any(F.col("p_type"), " _").alias("parts"), F.size(text.split_any(F.col("p_name"), " ", True)).cast("long").alias("n"), text.to_int(F.concat(F.lit(" 7"), F.col("p_name"))).cast("int").alias("k"), text.to_int(F.regexp_extract("p_brand", r"(\d+)", 1)).alias("brand"))


@query("SELECT l_orderkey, l_linenumber, format('{:g}', l_extendedprice) AS price, format('{:g}', l_discount * l_tax) AS small, '(' || format('{:g}', l_quantity) || ', ' || format('{:g}', l_tax) || ')' AS pair FROM lineitem")
def i8_six_digits(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", v.six_digits(F.col("l_extendedprice")).alias("price"), v.six_digits(F.col("l_discount") * F.col("l_tax")).alias("small"), v.shown((F.col("l_quantity"), F.col("l_tax"))).alias("pair"))


@query(f"SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch_us(ts) - lag(epoch_us(ts)) OVER {W} AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER {W}) / 1000.0 AS ms FROM {S}")
def f2_frame_times(spark, sf_dir):
    e = events.frame_ms(stream(spark, sf_dir).withColumn("us_at", F.unix_micros("ts")))
    return events.delta(e, "us_at", "us").select("event_id", text.stamp(F.col("ts")).alias("stamp"), "us", "ms")


@query("SELECT r_name, CASE r_regionkey WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS x, CASE r_regionkey WHEN 1 THEN 0.0::DOUBLE WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE r_regionkey WHEN 1 THEN -1.0::DOUBLE WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS z FROM region")
def i7_keywords(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(w) for w in ("RED", "negative z", "half", "0.25", "bogus")]), F.col("r_regionkey") + 1)
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", *[c.alias(n) for n, c in zip("xyz", v.keyword(words), strict=True)])


# --- predicates and joins


@query(f"SELECT b.label AS box, p.idx FROM {BOX} b JOIN {XYZ} p ON p.x BETWEEN b.minx * 0.4 AND b.maxx * 0.4 AND p.y BETWEEN b.miny * 0.4 AND b.maxy * 0.4 AND p.z BETWEEN b.minz * 0.4 AND b.maxz * 0.4")
def d5_boxes_with_points(spark, sf_dir):
    p = xyz(spark, sf_dir)
    b = boxes.aabb(p, "label").select(F.col("label").alias("box"), *[(F.col(n) * 0.4).alias(n) for n in boxes.NAMES])
    return boxes.boxes_with_points(b, p.drop("label"), 0.25).select("box", "idx")


_NEAR = "(SELECT idx, " + ", ".join(f"{a} - 0.03 AS min{a}, {a} + 0.03 AS max{a}" for a in "xyz") + f" FROM {XYZ})"


@query(f"SELECT l.idx AS a, r.idx AS b FROM {_NEAR} l JOIN {_NEAR} r ON l.idx < r.idx AND " + " AND ".join(f"l.min{a} <= r.max{a} AND r.min{a} <= l.max{a}" for a in "xyz"))
def d6_boxes_with_boxes(spark, sf_dir):
    b = xyz(spark, sf_dir).select("idx", *[(F.col(a) - 0.03).alias("min" + a) for a in "xyz"], *[(F.col(a) + 0.03).alias("max" + a) for a in "xyz"])
    return boxes.boxes_with_boxes(b, "idx", 0.1)


def _sql_triangle(mid=("0", "0", "0"), half=("0.15", "0.15", "0.15")) -> str:
    """The reproduced test of a box, by default |x| <= 0.15, and the triangle e0..e8, in SQL."""
    t = [[f"(e{3 * k + i} - {mid[i]})" for i in range(3)] for k in range(3)]
    edges = [[f"({t[(k + 1) % 3][i]} - {t[k][i]})" for i in range(3)] for k in range(3)]
    tests = []
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        for e in edges:
            p = [f"({x[b]} * {e[a]} - {x[a]} * {e[b]})" for x in t]
            tests.append(f"greatest(-greatest({', '.join(p)}), least({', '.join(p)})) > {half[b]} * abs({e[a]}) + {half[a]} * abs({e[b]}) + 1.1920928955078125e-07")
    for k in range(3):
        c = ", ".join(x[k] for x in t)
        tests.append(f"(least({c}) > {half[k]} AND (greatest({c}) + {half[k]} > 1.1920928955078125e-07 OR least({c}) - {half[k]} > 1.1920928955078125e-07))")
    n = [f"({edges[0][(i + 1) % 3]} * {edges[1][(i + 2) % 3]} - {edges[0][(i + 2) % 3]} * {edges[1][(i + 1) % 3]})" for i in range(3)]
    tests.append("abs(" + " + ".join(f"{n[i]} * {t[0][i]}" for i in range(3)) + ") > " + " + ".join(f"{h} * abs({x})" for h, x in zip(half, n, strict=True)) + " + 1.1920928955078125e-07")
    return "NOT (" + " OR ".join(tests) + ")"


@query(f"SELECT idx, {_sql_triangle()} AS hit FROM {P}")
def c7_box_triangle(spark, sf_dir):
    b = v.vec(-0.15, -0.15, -0.15, 0.15, 0.15, 0.15)
    return points(spark, sf_dir).select("idx", boxes.intersects_triangle(b, V(0), V(3), V(6)).alias("hit"))


@query(f"SELECT idx, {R('x')} AS x, {R('z')} AS y, {R('y')} AS z FROM {XYZ}")
def b3_swap_yz(spark, sf_dir):
    p = joins.swap_yz(xyz(spark, sf_dir).drop("label"))
    return p.select("idx", *[r(F.col(a)).alias(a) for a in "xyz"])


@query(f"SELECT idx, {R('greatest(x, y, z)')} AS most, {R('least(x, y, z)')} AS least FROM {XYZ}")
def g4_three_way(spark, sf_dir):
    a = [F.col(c) for c in "xyz"]
    return xyz(spark, sf_dir).select("idx", r(v.greatest3(*a)).alias("most"), r(v.least3(*a)).alias("least"))


@query(f"SELECT idx, CASE WHEN idx = 7 THEN 9.0::DOUBLE ELSE {R('x')} END AS x FROM {XYZ}")
def a26_set_at(spark, sf_dir):
    return joins.set_at(xyz(spark, sf_dir), "x", 7, F.lit(9.0)).select("idx", r(F.col("x")).alias("x"))


@query(f"SELECT idx, x, y, z, {', '.join(f'CASE WHEN idx % 3 = 0 THEN 1.0::DOUBLE ELSE abs({a}) END AS {c}' for a, c in zip('xyz', 'rgb', strict=True))} FROM {XYZ}")
def d1_zip(spark, sf_dir):
    p = xyz(spark, sf_dir)
    colours = p.where("idx % 3 <> 0").select("idx", *[F.abs(a).alias(c) for a, c in zip("xyz", "rgb", strict=True)])
    return joins.zipped(p.drop("label"), colours=colours)


@query("SELECT vec_id AS idx, " + ", ".join(f"CASE WHEN label % 2 = 0 THEN {R(_sql_hash(f'label::BIGINT * 3 + {k}'))} ELSE 1.0 END AS {c}" for k, c in enumerate("rgb")) + " FROM embeddings")
def d2_label_colours(spark, sf_dir):
    p = xyz(spark, sf_dir)
    labels = p.select("idx", F.when(F.col("label") % 2 == 0, F.col("label").cast("long")).otherwise(F.lit(text.NO_LABEL)).alias("label"))
    out = joins.with_label_colours(p.select("idx", *[F.lit(1.0).alias(c) for c in "rgb"]), labels)
    return out.select("idx", *[r(F.col(c)).alias(c) for c in "rgb"])


_SUBS = "(VALUES ('click', 1), ('click', 2), ('view', 2), ('error', 3))"


@query(f"SELECT event_id, event_type, CAST(receiver_id AS BIGINT) AS receiver_id FROM events JOIN (SELECT * FROM {_SUBS} t(event_type, receiver_id)) USING (event_type)")
def d3_dispatch(spark, sf_dir):
    subs = spark.createDataFrame([("click", 1), ("click", 2), ("click", 2), ("view", 2), ("error", 3)], "event_type string, receiver_id long")
    return events.dispatch(stream(spark, sf_dir), subs).select("event_id", "event_type", "receiver_id")


@query(f"SELECT p.idx, t.k, {R('p.x + 0.5 * t.x')} AS x, {R('p.y + 0.5 * t.y')} AS y, {R('greatest(p.z / sqrt(p.x * p.x + p.y * p.y + p.z * p.z), 0.2)')} AS shade FROM {XYZ} p, (VALUES (0, -0.5, -0.5), (1, 0.5, -0.5), (2, 0.0, 0.5)) t(k, x, y)")
def d4_instanced(spark, sf_dir):
    mesh = generators.triangle(spark).select(F.col("idx").cast("int").alias("k"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    world, shade = joins.shaded((F.col("vx"), F.col("vy"), F.col("vz")), tuple(F.col(a) for a in "xyz"), tuple(F.col(a) for a in "xyz"), F.lit(0.5), v.vec(0, 0, 1))
    return joins.instanced(xyz(spark, sf_dir), mesh).select("idx", "k", r(world[0]).alias("x"), r(world[1]).alias("y"), r(shade).alias("shade"))


@query(f"SELECT f.idx, c.corner, p.x, p.y, p.z FROM (SELECT idx, [idx, idx + 1, idx * 2] AS at FROM {XYZ}) f, (SELECT unnest([0, 1, 2]) AS corner) c LEFT JOIN {XYZ} p ON p.idx = f.at[c.corner + 1]")
def d8_face_corners(spark, sf_dir):
    p = xyz(spark, sf_dir)
    faces = p.select("idx", F.col("idx").alias("i0"), (F.col("idx") + 1).alias("i1"), (F.col("idx") * 2).alias("i2"))
    return joins.face_corners(faces, p)


@query("SELECT p_brand AS shader, list_sort(list(p_partkey)) AS ids FROM part WHERE p_size > 25 GROUP BY p_brand")
def e11_by_shader(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return joins.by_shader(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("shader"), "p_size").where("p_size > 25"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS idx, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 3] AS DOUBLE) AS y, CAST(embedding[3 * i + 2] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(21)) AS i)")
def b1_triples(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select("vec_id", F.inline(joins.triples(F.col("embedding"))))
    return joins.swap_yz(rows)


@query(f"SELECT label, CAST(k AS INT) AS k, {R('CASE WHEN sx THEN maxx ELSE minx END')} AS x, {R('CASE WHEN sy THEN maxy ELSE miny END')} AS y, {R('CASE WHEN sz THEN maxz ELSE minz END')} AS z FROM {BOX}, (SELECT row_number() OVER (ORDER BY bit, i, e) - 1 AS k, ((i | (e * bit)) & 4) > 0 AS sx, ((i | (e * bit)) & 2) > 0 AS sy, ((i | (e * bit)) & 1) > 0 AS sz FROM (SELECT unnest([1, 2, 4]) AS bit), (SELECT unnest(range(8)) AS i), (SELECT unnest([0, 1]) AS e) WHERE i & bit = 0)")
def b8_wireframe(spark, sf_dir):
    b = boxes.aabb(xyz(spark, sf_dir), "label")
    rows = b.select("label", F.posexplode(boxes.wireframe(boxes.columns())).alias("k", "p"))
    return rows.select("label", "k", *[r(F.col(f"p.{a}")).alias(a) for a in "xyz"])


# --- events


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM {S}")
def d9_last_known(spark, sf_dir):
    return events.last_known(stream(spark, sf_dir), F.when(F.col("event_type") == "view", F.col("value")), "position").select("event_id", "position")


@query(f"SELECT event_id, {R(f'value - lag(value) OVER {W}')} AS step FROM {S}")
def f1_delta(spark, sf_dir):
    return events.delta(stream(spark, sf_dir), "value", "step").select("event_id", r(F.col("step")).alias("step"))


_F3 = f'(SELECT session, "window", avg(value) AS mean FROM (SELECT *, (row_number() OVER {W} - 1) // 10 AS "window" FROM {S}) GROUP BY ALL HAVING count(*) = 10)'


@query(f'SELECT session, "window", {R("mean")} AS mean FROM {_F3}')
def f3_count_windows(spark, sf_dir):
    return events.count_windows(stream(spark, sf_dir), "value").select("session", "window", r(F.col("mean")).alias("mean"))


@query(f'WITH m AS {_F3}, g AS (SELECT session, "window", list(mean) OVER (PARTITION BY session ORDER BY "window" ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS got FROM m) SELECT session, "window", {R("list_sum(got) + 60 * (50 - len(got))")} AS total FROM g')
def f4_ring(spark, sf_dir):
    means = events.recent(events.count_windows(stream(spark, sf_dir), "value"))
    return means.select("session", "window", r(F.expr("aggregate(ring, 0D, (a, x) -> a + x)")).alias("total"))


@query(f"SELECT event_id, event_type = 'click' AS down, coalesce(event_type <> lag(event_type) OVER {W}, true) AS changed FROM {S} WHERE event_type IN ('click', 'view')")
def f5_pressed(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("action", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0).otherwise(2)).withColumn("key", F.lit(1))
    return events.pressed(e).select("event_id", "down", "changed")


@query("SELECT event_id, " + ", ".join(f"coalesce(last_value(CASE WHEN event_id % 3 = {k} AND event_type IN ('click', 'view') THEN event_type = 'click' END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS {n}" for k, n in enumerate(("left", "right", "middle"))) + f' FROM {S}')
def f6_button_flags(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("action", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0).otherwise(2)).withColumn("button", F.col("event_id") % 3)
    return events.button_flags(e).select("event_id", "left", "right", "middle")


@query()
def f10_trackball(spark, sf_dir):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "move"), ("click", "press"), ("signup", "release"), ("purchase", "wheel"), ("error", "key_press")) for x in pair]), F.col("event_type"))
    key = F.element_at(F.array(*[F.lit(k) for k in "WASD"]), (F.col("event_id") % 4 + 1).cast("int"))
    e = stream(spark, sf_dir).select("session", "ts", "event_id", kind.alias("kind"), F.col("value").alias("x"), (100 - F.col("value")).alias("y"), (F.col("event_id") % 3).alias("button"), (F.col("value") - 50).alias("dy"), key.alias("key"))
    states = events.trackball(e)
    return states.select("event_id", *[r(F.col(c)).alias(c) for c in states.columns[3:]])


@query(f"SELECT event_id, event_type FROM {S} WHERE event_id % 4 IN (0, 1)")
def c9_press_or_release(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("action", F.col("event_id") % 4).withColumn("key", F.col("event_type"))
    return events.pressed(e).select("event_id", "event_type")


_TURN = "(azimuth - 0.2 * e.value)"
_RISE = "(elevation + 0.2 * (e.value - 50))"


@query(
    f"WITH RECURSIVE e AS (SELECT session, value, row_number() OVER {W} AS n FROM {S}), f AS (SELECT DISTINCT session, 0::BIGINT AS n, 0::DOUBLE AS azimuth, 0::DOUBLE AS elevation FROM e "
    f"UNION ALL SELECT e.session, e.n, CASE WHEN {_TURN} < 0 THEN {_TURN} + 360 WHEN {_TURN} >= 360 THEN {_TURN} - 360 ELSE {_TURN} END, CASE WHEN {_RISE} <= -90 THEN -89.9 WHEN {_RISE} >= 90 THEN 89.9 ELSE {_RISE} END FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1) "
    f"SELECT session, round(arg_max(azimuth, n), 4) + 0.0 AS azimuth, round(arg_max(elevation, n), 4) + 0.0 AS elevation FROM f GROUP BY session"
)
def f8_orbit(spark, sf_dir):
    e = events.orbit(stream(spark, sf_dir).withColumn("dx", F.col("value")).withColumn("dy", F.col("value") - 50))
    return e.select("session", F.round("state.azimuth", 4).alias("azimuth"), F.round("state.elevation", 4).alias("elevation"))


_FOV = "(CASE WHEN e.shift THEN least(greatest(fov - sign(e.dy), 1), 90) ELSE fov END)"


@query(
    f"WITH RECURSIVE e AS (SELECT session, value - 50 AS dy, event_id % 3 = 0 AS shift, row_number() OVER {W} AS n FROM {S}), f AS (SELECT DISTINCT session, 0::BIGINT AS n, 5::DOUBLE AS radius, 45::DOUBLE AS fov FROM e "
    f"UNION ALL SELECT e.session, e.n, radius * (CASE WHEN e.shift OR e.dy = 0 THEN 1 WHEN e.dy > 0 THEN 0.9 ELSE 1.1 END), {_FOV} FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1) "
    f"SELECT session, round(log10(arg_max(radius, n)), 5) + 0.0 AS radius_log10, {R('arg_max(fov, n)')} AS fov FROM f GROUP BY session"
)
def f9_zoom(spark, sf_dir):
    """Every event a wheel step, every third with the shift key; the radius as its logarithm, as many steps change it by orders."""
    e = stream(spark, sf_dir).withColumn("dy", F.col("value") - 50).withColumn("shift", F.col("event_id") % 3 == 0)
    return events.zoom(e).select("session", F.round(F.log10("state.radius"), 5).alias("radius_log10"), r(F.col("state.fov")).alias("fov"))


@query("SELECT p_brand AS key, arg_max(p_name, p_partkey) AS handler FROM part GROUP BY p_brand")
def k6_latest_handlers(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return events.latest_handlers(p.select(F.col("p_brand").alias("key"), F.col("p_name").alias("handler"), F.col("p_partkey").alias("seq")))


# --- registry and sets

_EDGES = "(VALUES " + ", ".join(f"('{b}', '{d}')" for b, ds in catalog.TYPES.items() for d in ds) + ")"
_CLOSURE = f"e(base, derived) AS {_EDGES}, c AS (SELECT base, derived FROM e UNION SELECT c.base, e.derived FROM c JOIN e ON e.base = c.derived)"
_NAMES = sorted({x for b, ds in catalog.TYPES.items() for x in (b, *ds)})
_INSTANCES = f"(SELECT p_partkey AS seq, list_extract({_NAMES!r}, CAST(p_partkey % {len(_NAMES)} AS INT) + 1) AS type, p_name AS name FROM part)"


def _instances(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = F.array(*[F.lit(x) for x in _NAMES])
    return p.select(F.col("p_partkey").alias("seq"), F.get(names, (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("type"), F.col("p_name").alias("name"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT base, derived FROM c")
def h3_subclass_closure(spark, sf_dir):
    return catalog.closure(catalog.type_edges(spark))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT seq, type, name FROM {_INSTANCES} WHERE type = 'CameraBase' OR type IN (SELECT derived FROM c WHERE base = 'CameraBase')")
def d10_of_type(spark, sf_dir):
    return catalog.of_type(_instances(spark, sf_dir), catalog.type_edges(spark), "CameraBase").select("seq", "type", "name")


@query(f"WITH RECURSIVE {_CLOSURE} SELECT seq, type, name FROM {_INSTANCES} WHERE type = 'SystemBase' OR type IN (SELECT derived FROM c WHERE base = 'SystemBase') ORDER BY seq LIMIT 1")
def g1_first_of_type(spark, sf_dir):
    return catalog.first_of_type(_instances(spark, sf_dir), catalog.type_edges(spark), "SystemBase").select("seq", "type", "name")


@query(f"SELECT type, list_sort(list(DISTINCT seq)) AS seqs FROM {_INSTANCES} GROUP BY type")
def m4_instance_map(spark, sf_dir):
    return catalog.instance_map(_instances(spark, sf_dir))


@query(f"SELECT seq, type, CAST(row_number() OVER (PARTITION BY type ORDER BY seq) - 1 AS INT) AS id FROM {_INSTANCES}")
def m7_numbered(spark, sf_dir):
    return catalog.numbered(_instances(spark, sf_dir), "seq", "type").select("seq", "type", "id")


@query("SELECT * FROM (VALUES ('click', CAST(1 AS BIGINT)), ('view', CAST(3 AS BIGINT))) t(event_type, receiver_id)")
def h4_subscriptions(spark, sf_dir):
    subs = spark.createDataFrame([("click", 1), ("view", 2)], "event_type string, receiver_id long")
    return catalog.unsubscribe(catalog.subscribe(catalog.subscribe(subs, "view", 3), "click", 1), "view", 2)


# --- generators


@query(f"SELECT idx, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM (SELECT i AS idx, 1 + 2 * nx AS x, 2 + 2 * ny AS y, 3 + 2 * nz AS z FROM (SELECT i, cos(i % 9 * pi() / 4) * sin(i // 9 * pi() / 4) AS nx, cos(i // 9 * pi() / 4) AS ny, sin(i % 9 * pi() / 4) * sin(i // 9 * pi() / 4) AS nz FROM range(45) t(i)))")
def j2_sphere(spark, sf_dir):
    return generators.sphere(spark, (1, 2, 3), 2.0, 8, 4).select("idx", *[r(F.col(a)).alias(a) for a in "xyz"])


@query("SELECT q * 6 + k AS idx, f + CASE k WHEN 0 THEN 0 WHEN 1 THEN 9 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 9 ELSE 10 END AS at FROM (SELECT q, q // 8 * 9 + q % 8 AS f FROM range(32) t(q)), range(6) u(k)")
def j2_sphere_indices(spark, sf_dir):
    return generators.sphere_indices(spark, 8, 4)


_CORNERS = "(VALUES (0, -1, -1, -1), (1, 1, -1, -1), (2, 1, 1, -1), (3, -1, 1, -1), (4, -1, -1, 1), (5, 1, -1, 1), (6, 1, 1, 1), (7, -1, 1, 1)) c(corner, x, y, z)"
_FACES = ", ".join(f"({6 * f + k}, {corner}, {n[0]}, {n[1]}, {n[2]}, {k})" for f, (face, n) in enumerate(zip(generators.FACES, generators.FACE_NORMALS, strict=True)) for k, corner in enumerate(face))


@query(f"SELECT CAST(idx AS BIGINT) AS idx, x * 0.5::DOUBLE AS x, y * 0.5::DOUBLE AS y, z * 0.5::DOUBLE AS z, nx::DOUBLE AS nx, ny::DOUBLE AS ny, nz::DOUBLE AS nz FROM (VALUES {_FACES}) f(idx, corner, nx, ny, nz, k) JOIN {_CORNERS} USING (corner)")
def j1_box(spark, sf_dir):
    return generators.box(spark).select("idx", "x", "y", "z", "nx", "ny", "nz")


@query("SELECT i AS idx, i % 100 AS x, i // 100 % 100 AS y, i // 10000 AS z FROM range(1000000) t(i)")
def j3_grid(spark, sf_dir):
    return generators.grid(spark).drop("scale")


@query(f"SELECT i AS idx, {R('i * 0.1::DOUBLE')} AS x, {R('2 * sin(3 * i * 0.1::DOUBLE)')} AS y FROM range(100) t(i)")
def i28_sine(spark, sf_dir):
    return generators.sine(spark, 2.0, 3.0).select("idx", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


# --- sinks: the lines of each format


@query(f"SELECT CAST(count(*) AS VARCHAR) AS value FROM {XYZ} UNION ALL SELECT printf('%.6f %.6f %.6f', x, y, z) FROM {XYZ}")
def a1_xyz_sink(spark, sf_dir):
    return formats.xyz_lines(xyz(spark, sf_dir))


@query(f"SELECT 'OFF' AS value UNION ALL SELECT count(*) || ' ' || count(*) || ' 0' FROM {XYZ} UNION ALL SELECT printf('%.6f %.6f %.6f', x, y, z) FROM {XYZ} UNION ALL SELECT '3 ' || idx || ' 0 1 255 255 255' FROM {XYZ}")
def a3_off_sink(spark, sf_dir):
    p = xyz(spark, sf_dir)
    return formats.off_lines(p, p.select("idx", F.col("idx").alias("i0"), F.lit(0).alias("i1"), F.lit(1).alias("i2")))


@query(f"SELECT 'v ' || format('{{:g}}', x) || ' ' || format('{{:g}}', y) || ' ' || format('{{:g}}', z) AS value FROM {XYZ} UNION ALL SELECT 'f ' || idx + 1 || ' 1 2' FROM {XYZ}")
def a7_obj_sink(spark, sf_dir):
    p = xyz(spark, sf_dir)
    return formats.obj_lines(p, p.select("idx", (F.col("idx") + 1).alias("i0"), F.lit(1).cast("long").alias("i1"), F.lit(2).cast("long").alias("i2")))


@query(f"SELECT unnest(['ply', 'format ascii 1.0', 'property float x', 'property float y', 'property float z', 'end_header']) AS value UNION ALL SELECT 'element vertex ' || count(*) FROM {XYZ} UNION ALL SELECT format('{{:g}}', x) || ' ' || format('{{:g}}', y) || ' ' || format('{{:g}}', z) FROM {XYZ}")
def a9_ply_sink(spark, sf_dir):
    return formats.ply_lines(xyz(spark, sf_dir))


def _counted_sql(n: str, pattern: str = "%f") -> str:
    return f"SELECT CAST(count(*) AS VARCHAR) AS value FROM {P} UNION ALL SELECT printf('{', '.join([pattern] * 3)}', {n}) FROM {P}"


@query(" UNION ALL ".join((_counted_sql("e0, e1, e2"), _counted_sql("e3, e4, e5"), _counted_sql("abs(e6), abs(e7), abs(e8)"), _counted_sql("idx, 0, 1", "%d"))))
def a5_mesh_sink(spark, sf_dir):
    p = points(spark, sf_dir)
    part = lambda names, columns: p.select("idx", *[c.alias(n) for n, c in zip(names, columns, strict=True)])
    colours = part("rgb", [F.abs(E(i)) for i in (6, 7, 8)])
    faces = part(("i0", "i1", "i2"), [F.col("idx"), F.lit(0).cast("long"), F.lit(1).cast("long")])
    return formats.mesh_lines(part("xyz", V(0)), part(("nx", "ny", "nz"), V(3)), colours, faces)
