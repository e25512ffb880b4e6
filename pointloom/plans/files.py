"""Queries that write a file of each format, read it back and return what was read; and sinks with all attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import colour_byte
from ..sources import formats
from .registry import XYZ, E, P, R, V, points, query, r, xyz


def _part(p: DataFrame, names, columns) -> DataFrame:
    return p.select("idx", *[c.alias(n) for n, c in zip(names, columns, strict=True)])


def _attributes(spark, sf_dir) -> dict[str, DataFrame]:
    """Points, normals, colours, texture coordinates and faces (from 0) of the embeddings."""
    p = points(spark, sf_dir)
    return {
        "points": _part(p, "xyz", V(0)),
        "normals": _part(p, ("nx", "ny", "nz"), V(3)),
        "colors": _part(p, "rgba", [F.abs(E(i)) for i in (6, 7, 8, 9)]),
        "uvs": _part(p, "uv", V(10, 2)),
        "faces": _part(p, ("i0", "i1", "i2"), [F.col("idx"), F.lit(0).cast("long"), F.lit(1).cast("long")]),
    }


def _sections(tables: dict[str, DataFrame], names: dict[str, str], places: int = 6) -> DataFrame:
    """(section, idx, a, b, c, d) of the tables that a reader returns; what a section lacks is null. Texts of six
    significant digits need more places, or what is rounded again may lie halfway."""

    def rows(section: str) -> DataFrame:
        columns = names[section].split()
        own = [F.round(F.col(c).cast("double"), places) for c in columns] + [F.lit(None).cast("double")] * (4 - len(columns))
        return tables[section].where("_corrupt_record is null").select(F.lit(section).alias("section"), "idx", *[c.alias(n) for c, n in zip(own, "abcd", strict=True)])

    return reduce(DataFrame.unionByName, map(rows, names))


def _sql(section: str, *columns: str, places: int = 6) -> str:
    own = [f"round(CAST({c} AS DOUBLE), {places}) + 0.0" for c in columns] + ["CAST(NULL AS DOUBLE)"] * (4 - len(columns))
    return f"SELECT '{section}' AS section, idx, " + ", ".join(f"{c} AS {n}" for c, n in zip(own, "abcd", strict=True)) + f" FROM {P}"


def _g(*columns: str) -> list[str]:
    return [f"format('{{:g}}', {c})" for c in columns]


def _b(c: str) -> str:
    return f"least(greatest(floor({c} * 255), 0), 255)"


def _written(spark, lines: DataFrame) -> str:
    path = formats.scratch(spark)
    formats.write_lines(lines, path)
    return path


# --- text formats, there and back


@query(f"SELECT idx, {', '.join(f'{R(a)} AS {a}' for a in 'xyz')} FROM {XYZ}")
def a2_xyz_source(spark, sf_dir):
    path = _written(spark, formats.xyz_lines(xyz(spark, sf_dir)))
    return formats.read_xyz(spark, path)["points"].select("idx", *[r(F.col(a)).alias(a) for a in "xyz"])


@query(" UNION ALL ".join((_sql("points", "e0", "e1", "e2"), _sql("faces", "idx", "0", "1"), _sql("colors", *[f"{_b(f'abs(e{i})')} / 255.0" for i in (6, 7, 8)]))))
def a4_off_source(spark, sf_dir):
    """A face's colour is that of its first vertex, as a byte."""
    a = _attributes(spark, sf_dir)
    path = _written(spark, formats.off_lines(a["points"], a["faces"], a["colors"]))
    return _sections(formats.read_off(spark, path), {"points": "x y z", "faces": "i0 i1 i2", "colors": "r g b"})


@query(f"SELECT '3 ' || idx || ' 0 1 ' || {' || \' \' || '.join(f'CAST({_b(f"abs(e{i})")} AS INT)' for i in (6, 7, 8))} AS value FROM {P} UNION ALL SELECT printf('%.6f %.6f %.6f', e0, e1, e2) FROM {P} UNION ALL SELECT 'OFF' UNION ALL SELECT count(*) || ' ' || count(*) || ' 0' FROM {P}")
def a3_off_colour_sink(spark, sf_dir):
    a = _attributes(spark, sf_dir)
    return formats.off_lines(a["points"], a["faces"], a["colors"])


@query(" UNION ALL ".join((_sql("points", "e0", "e1", "e2"), _sql("normals", "e3", "e4", "e5"), _sql("colors", "abs(e6)", "abs(e7)", "abs(e8)"), _sql("faces", "idx", "0", "1"))))
def a6_mesh_source(spark, sf_dir):
    a = _attributes(spark, sf_dir)
    path = _written(spark, formats.mesh_lines(a["points"], a["normals"], a["colors"].drop("a"), a["faces"]))
    return _sections(formats.read_mesh(spark, path), {"points": "x y z", "normals": "nx ny nz", "colors": "r g b", "faces": "i0 i1 i2"})


def _one_based(faces: DataFrame) -> DataFrame:
    return faces.select("idx", *[(F.col(f"i{k}") + 1).alias(f"i{k}") for k in range(3)])


@query(" UNION ALL ".join((_sql("points", *_g("e0", "e1", "e2"), places=12), _sql("normals", *_g("e3", "e4", "e5"), places=12), _sql("colors", *_g("abs(e6)", "abs(e7)", "abs(e8)"), places=12), _sql("uvs", *_g("e10", "e11"), places=12), _sql("faces", "idx + 1", "1", "2"))))
def a8_obj_source(spark, sf_dir):
    """All attributes; indices in the layout of vertex, texture and normal."""
    a = _attributes(spark, sf_dir)
    path = _written(spark, formats.obj_lines(a["points"], _one_based(a["faces"]), a["normals"], a["uvs"], a["colors"]))
    return _sections(formats.read_obj(spark, path), {"points": "x y z", "normals": "nx ny nz", "colors": "r g b", "uvs": "u v", "faces": "i0 i1 i2"}, places=12)


#: What stands between the indices of one corner, and how many there are.
_LAYOUTS = {"v": ("", 1), "v//n": ("//", 2), "v/t": ("/", 2), "v/t/n": ("/", 3)}


def _layout_sql(k: str) -> str:
    mark, n = _LAYOUTS[k]
    corners = " || ' ' || ".join(f" || '{mark}' || ".join([c] * n) for c in ("(idx + 1)", "1", "2"))
    line = lambda tag, *c: f"SELECT '{k}' AS layout, '{tag} ' || " + " || ' ' || ".join(_g(*c)) + f" AS value FROM {P}"
    out = [f"SELECT '{k}' AS layout, 'f ' || {corners} AS value FROM {P}", line("v", "e0", "e1", "e2", *(("abs(e6)", "abs(e7)", "abs(e8)") if k == "v" else ()))]
    if "n" in k:
        out.append(line("vn", "e3", "e4", "e5"))
    if "t" in k:
        out.append(line("vt", "e10", "e11"))
    return " UNION ALL ".join(out)


@query(" UNION ALL ".join(map(_layout_sql, _LAYOUTS)))
def a7_obj_layouts(spark, sf_dir):
    """The four index layouts; colours with the first."""
    a = _attributes(spark, sf_dir)
    make = lambda k: formats.obj_lines(a["points"], _one_based(a["faces"]), a["normals"] if "n" in k else None, a["uvs"] if "t" in k else None, a["colors"] if k == "v" else None)
    return reduce(DataFrame.unionByName, [make(k).select(F.lit(k).alias("layout"), "value") for k in _LAYOUTS])


_PLY_HEAD = ["ply", "format ascii 1.0", *[f"property float {c}" for c in ("x", "y", "z", "nx", "ny", "nz")], *[f"property uchar {c}" for c in ("red", "green", "blue", "alpha")], "property float u", "property float v", "property int vertex1", "property int vertex2", "property list uchar int vertex_indices", "end_header"]
_PLY_VERTEX = " || ' ' || ".join([*_g("e0", "e1", "e2", "e3", "e4", "e5"), *[f"CAST({_b(f'abs(e{i})')} AS INT)" for i in (6, 7, 8, 9)], *_g("e10", "e11")])


def _ply(spark, sf_dir) -> DataFrame:
    a = _attributes(spark, sf_dir)
    edges = a["faces"].select("idx", F.col("i0").alias("v1"), F.col("i1").alias("v2"))
    return formats.ply_lines(a["points"], a["faces"], a["normals"], a["colors"], edges, a["uvs"])


@query(f"SELECT unnest({_PLY_HEAD!r}) AS value UNION ALL SELECT 'element ' || unnest(['vertex', 'edge', 'face']) || ' ' || count(*) FROM {P} UNION ALL SELECT {_PLY_VERTEX} FROM {P} UNION ALL SELECT idx || ' 0' FROM {P} UNION ALL SELECT '3 ' || idx || ' 0 1' FROM {P}")
def a9_ply_attribute_sink(spark, sf_dir):
    return _ply(spark, sf_dir)


@query(
    " UNION ALL ".join((_sql("points", *_g("e0", "e1", "e2"), places=12), _sql("normals", *_g("e3", "e4", "e5"), places=12), _sql("colors", *[f"{_b(f'abs(e{i})')} / 255.0" for i in (6, 7, 8, 9)], places=12), _sql("uvs", *_g("e10", "e11"), places=12), _sql("edges", "idx", "0"), _sql("faces", "idx", "0", "1")))
)
def a10_ply_source(spark, sf_dir):
    path = _written(spark, _ply(spark, sf_dir))
    return _sections(formats.read_ply(spark, path), {"points": "x y z", "normals": "nx ny nz", "colors": "r g b a", "uvs": "u v", "edges": "v1 v2", "faces": "i0 i1 i2"}, places=12)


# --- binary records


def _records(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("idx", *[E(i).alias(n) for i, n in enumerate(formats.FIELDS)])


@query(f"SELECT idx, {', '.join(f'{R(f'e{i}')} AS {n}' for i, n in enumerate(formats.FIELDS))} FROM {P}")
def a12_alp_source(spark, sf_dir):
    path = formats.scratch(spark) + ".alp"
    formats.write_alp(_records(spark, sf_dir), path)
    return formats.read_alp(spark, path).select("idx", *[r(F.col(n)).alias(n) for n in formats.FIELDS])


_OWN = (("id", "<u4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("label", "<i2"))


@query(f"SELECT idx, idx AS id, {', '.join(f'{R(a)} AS {a}' for a in 'xyz')}, CAST(label AS BIGINT) AS label FROM {XYZ}")
def l3_alp_record(spark, sf_dir):
    """A record of other fields."""
    path = formats.scratch(spark) + ".alp"
    formats.write_alp(xyz(spark, sf_dir).withColumn("id", F.col("idx")), path, _OWN)
    return formats.read_alp(spark, path, _OWN).select("idx", "id", *[r(F.col(a)).alias(a) for a in "xyz"], "label")


@query(f"SELECT 8 + 36 * count(*) AS length, printf('%02x%02x%02x%02x24000000', count(*) & 255, (count(*) >> 8) & 255, (count(*) >> 16) & 255, (count(*) >> 24) & 255) AS head FROM {P}")
def a16_raw_bytes(spark, sf_dir):
    """A file's length and first bytes: count and size of its records."""
    path = formats.scratch(spark) + ".alp"
    formats.write_alp(_records(spark, sf_dir), path)
    return formats.read_bytes(spark, path, 0, 8).select("length", F.lower(F.hex("content")).alias("head"))


@query(f"SELECT CAST(8 + 36 * count(*) AS BIGINT) AS bytes FROM {P}")
def e14_byte_total(spark, sf_dir):
    return formats.byte_total(_records(spark, sf_dir))


@query(f"SELECT label, bool_or(idx % 97 = 0) AS use_alpha FROM {P} GROUP BY label")
def e15_use_alpha(spark, sf_dir):
    p = points(spark, sf_dir).select("label", F.when(F.col("idx") % 97 == 0, F.lit(0.5)).alias("a"))
    return formats.use_alpha(p, "label")


@query(f"SELECT idx, {R('e0')} AS x, {', '.join(f'CAST({_b(f"e{i}")} AS INT) AS b{i}' for i in range(3))} FROM {P}")
def b4_colour_bytes(spark, sf_dir):
    """The cache makes the table once and reads it from then on; colours as bytes."""
    path = formats.scratch(spark)
    once = [points(spark, sf_dir), points(spark, sf_dir).limit(0)]
    formats.cached(spark, path, lambda: once[0])
    again = formats.cached(spark, path, lambda: once[1])
    return again.select("idx", r(E(0)).alias("x"), *[colour_byte(E(i)).alias(f"b{i}") for i in range(3)])
