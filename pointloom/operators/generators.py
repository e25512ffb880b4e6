"""Mesh and grid generators. Each is a plan over range(); nothing is made on the driver but small literals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corners of each box face in drawing order (fixed values); bit pattern of a corner: see _corner.
FACES = ((0, 1, 2, 2, 3, 0), (5, 4, 7, 7, 6, 5), (4, 0, 3, 3, 7, 4), (1, 5, 6, 6, 2, 1), (4, 5, 1, 1, 0, 4), (3, 2, 6, 6, 7, 3))
FACE_NORMALS = ((0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0))
CORNER_UV = ((0, 0), (1, 0), (1, 1), (0, 1))

_VERTEX = "idx long, x double, y double, z double, nx double, ny double, nz double, u double, v double"


def _corner(k: int) -> tuple[int, int, int]:
    """Signs of corner k: counter-clockwise from the lower left, the far side from 4 on."""
    return (1 if k % 4 in (1, 2) else -1, 1 if k % 4 >= 2 else -1, 1 if k >= 4 else -1)


def box(spark: SparkSession, centre=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0)) -> DataFrame:
    """36 vertices; the index of each is its idx."""
    rows = []
    for face, normal in zip(FACES, FACE_NORMALS, strict=True):
        for j, k in enumerate(face):
            at = [float(c + 0.5 * s * d) for c, s, d in zip(centre, _corner(k), size, strict=True)]
            rows.append((len(rows), *at, *map(float, normal), *map(float, CORNER_UV[j % 4])))
    return spark.createDataFrame(rows, _VERTEX)


def sphere(spark: SparkSession, centre=(0.0, 0.0, 0.0), radius: float = 1.0, around: int = 6, down: int = 6) -> DataFrame:
    """(down + 1) * (around + 1) vertices, ring by ring from the upper pole."""
    ring, step = F.expr(f"id div {around + 1}"), F.col("id") % (around + 1)
    phi, theta = ring * (math.pi / down), step * (2 * math.pi / around)
    n = {"nx": F.cos(theta) * F.sin(phi), "ny": F.cos(phi), "nz": F.sin(theta) * F.sin(phi)}
    rows = spark.range((down + 1) * (around + 1))
    return rows.select(F.col("id").alias("idx"), *[(F.lit(float(c)) + radius * e).alias(a) for c, a, e in zip(centre, "xyz", n.values(), strict=True)], *[e.alias(k) for k, e in n.items()], (step / around).alias("u"), (ring / down).alias("v"))


def sphere_indices(spark: SparkSession, around: int = 6, down: int = 6) -> DataFrame:
    """(idx, at): six a quad, two triangles."""
    first = F.expr(f"(id div {around}) * {around + 1} + id % {around}")
    below = first + around + 1
    quad = F.array(first, below, first + 1, first + 1, below, below + 1)
    return spark.range(around * down).select("id", F.posexplode(quad).alias("k", "at")).select((F.col("id") * 6 + F.col("k")).alias("idx"), "at")


def grid(spark: SparkSession, n: int = 100, size: float = 0.5) -> DataFrame:
    """n**3 instances at whole coordinates, x fastest."""
    return spark.range(n**3).select(F.col("id").alias("idx"), (F.col("id") % n).alias("x"), F.expr(f"id div {n} % {n}").alias("y"), F.expr(f"id div {n * n}").alias("z"), F.lit(size).alias("scale"))


def triangle(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, -0.5, -0.5, 0.0), (1, 0.5, -0.5, 0.0), (2, 0.0, 0.5, 0.0)], "idx long, x double, y double, z double")


def sine(spark: SparkSession, amplitude: float = 1.0, frequency: float = 1.0, n: int = 100) -> DataFrame:
    x = F.col("id") * 0.1
    return spark.range(n).select(F.col("id").alias("idx"), x.alias("x"), (amplitude * F.sin(frequency * x)).alias("y"))
