"""Positional joins, label overwrite, instancing, face dereference, bounding points to shaders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as m
from ..functions import text
from ..functions import vector as v


def zipped(points: DataFrame, normals: DataFrame | None = None, colours: DataFrame | None = None) -> DataFrame:
    """Attributes of the same idx in one row; a missing colour is white, a missing normal null."""
    out = points
    if normals is not None:
        out = out.join(normals, "idx", "left")
    if colours is not None:
        out = out.join(colours, "idx", "left")
        for c in colours.columns:
            if c != "idx":
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(1.0)))
    return out


def triples(flat: Column, width: int = 3, names: str = "xyz") -> Column:
    """A flat array as an array of struct(idx, x, y, z); an incomplete rest is dropped. Use with inline()."""
    n = F.floor(F.size(flat) / width).cast("int")
    row = lambda i: F.struct(i.cast("long").alias("idx"), *[F.get(flat, i * width + k).cast("double").alias(c) for k, c in enumerate(names)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(F.array().cast("array<struct<idx:bigint," + ",".join(f"{c}:double" for c in names) + ">>"))


def swap_yz(df: DataFrame) -> DataFrame:
    return df.withColumns({"y": F.col("z"), "z": F.col("y")})


def with_label_colours(instances: DataFrame, labels: DataFrame, keep_last: bool = False) -> DataFrame:
    """r, g, b of each instance overwritten by its label's hash colour, where it has a label.

    keep_last reproduces a bound that leaves the last instance's colour."""
    rows = instances.join(labels.select("idx", "label"), "idx", "left")
    ok = F.col("label").isNotNull() & (F.col("label") != text.NO_LABEL)
    if keep_last:
        last = instances.agg(F.max("idx").alias("last"))  # one row
        rows = rows.crossJoin(F.broadcast(last))
        ok = ok & (F.col("idx") < F.col("last"))
    hashed = text.hash_colour(F.col("label"))
    return rows.withColumns({c: F.when(ok, h).otherwise(F.col(c)) for c, h in zip("rgb", hashed, strict=True)}).select(*instances.columns)


def label(points: DataFrame, labeler: Callable, schema: str = "idx long, label long") -> DataFrame:
    """A slot for any labeler of batches of points (pandas frames in, frames of schema out)."""
    return points.mapInPandas(labeler, schema)


def instanced(instances: DataFrame, mesh: DataFrame) -> DataFrame:
    """Every mesh vertex of every instance; the mesh is a generator's, of a size its parameters give."""
    return instances.crossJoin(F.broadcast(mesh))


def shaded(position: v.Vector, normal: v.Vector, offset: v.Vector, size: Column, light: v.Vector) -> tuple[v.Vector, Column]:
    """World position under a scale and translation, and the diffuse factor, at least 0.2."""
    return v.add(v.mul(position, size), offset), F.greatest(v.dot(v.normalize(normal), v.normalize(light)), F.lit(0.2))


def vertex_stage(model: list, view: list, projection: list, position: v.Vector, normal: v.Vector) -> tuple[v.Vector, v.Vector, v.Vector]:
    """World position, the normal by the inverse transpose of the model's linear part, and the clip position.

    Matrices take column vectors, with the translation in column 3."""
    point = (*position, F.lit(1.0))
    world = m.apply(model, point)
    linear = [row[:3] for row in model[:3]]
    return world[:3], m.apply(m.transpose(m.inverse(linear)), normal), m.apply(m.multiply(projection, view), world)


def instance_colour(colour: v.Vector) -> Column:
    """r, g, b and an alpha of 1."""
    return F.struct(*[c.alias(n) for c, n in zip((*colour, F.lit(1.0)), "rgba", strict=True)])


def face_corners(faces: DataFrame, points: DataFrame) -> DataFrame:
    """(idx, corner, x, y, z) of each face (idx, i0, i1, i2): one equi-join; unknown vertices give nulls."""
    long = faces.select(F.col("idx").alias("face"), F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "at"))
    named = points.select(F.col("idx").alias("at"), "x", "y", "z")
    return long.join(named, "at", "left").select(F.col("face").alias("idx"), "corner", "x", "y", "z")


def by_shader(renderables: DataFrame) -> DataFrame:
    """Ids of each shader's renderables, ascending; those without a shader are left out."""
    return renderables.where("shader is not null").groupBy("shader").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def set_at(df: DataFrame, column: str, idx: int, value: Column) -> DataFrame:
    """One row's value overwritten."""
    return df.withColumn(column, F.when(F.col("idx") == idx, value).otherwise(F.col(column)))


def append(rows: DataFrame, more: DataFrame, idx: str = "idx") -> DataFrame:
    """rows and after them `more`, whose idx (from 0) goes on after the last of rows; columns that one side lacks
    are null. For points, records, normals, colours, texture coordinates, indices or any attribute."""
    last = rows.agg((F.coalesce(F.max(idx), F.lit(-1)) + 1).alias("_last"))  # one row
    moved = more.crossJoin(F.broadcast(last)).withColumn(idx, F.col(idx) + F.col("_last")).drop("_last")
    return rows.unionByName(moved, allowMissingColumns=True)


def flat(rows: DataFrame, names: str = "x y z") -> DataFrame:
    """(idx, value): a row for each component, in order, as flat buffers have them."""
    parts = names.split()
    return rows.select("idx", F.posexplode(F.array(*parts)).alias("k", "value")).select((F.col("idx") * len(parts) + F.col("k")).alias("idx"), "value")


class Mesh:
    """A mesh with its instances, built step by step; each buffer is a DataFrame with an idx, or None.

    add() appends rows to a buffer, put() replaces it, at() overwrites one row; nothing is computed before
    vertices() or instances() is used."""

    BUFFERS = ("indices", "vertices", "normals", "colors", "uvs", "instance_colors", "instance_normals", "instance_transforms")

    def __init__(self, **buffers: DataFrame):
        self.buffers = {k: None for k in self.BUFFERS}
        for k, df in buffers.items():
            self.put(k, df)

    def put(self, buffer: str, rows: DataFrame | None) -> Mesh:
        if buffer not in self.buffers:
            raise KeyError(buffer)
        self.buffers[buffer] = rows
        return self

    def add(self, buffer: str, rows: DataFrame) -> Mesh:
        have = self.buffers[buffer]
        return self.put(buffer, rows if have is None else append(have, rows))

    def at(self, buffer: str, idx: int, **values: Column) -> Mesh:
        rows = self.buffers[buffer]
        for column, value in values.items():
            rows = set_at(rows, column, idx, value)
        return self.put(buffer, rows)

    def size(self, buffer: str) -> int:
        rows = self.buffers[buffer]
        return 0 if rows is None else rows.count()

    def empty(self, buffer: str) -> bool:
        rows = self.buffers[buffer]
        return rows is None or rows.isEmpty()

    def _joined(self, first: str, others: tuple[str, ...]) -> DataFrame:
        out = self.buffers[first]
        for k in others:
            if self.buffers[k] is not None:
                out = out.join(self.buffers[k], "idx", "left")
        return out

    def vertices(self) -> DataFrame:
        return self._joined("vertices", ("normals", "colors", "uvs"))

    def instances(self) -> DataFrame:
        return self._joined("instance_transforms", ("instance_colors", "instance_normals"))
