"""Means, centring and second moments of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def mean(points: DataFrame, *by: str) -> DataFrame:
    """mx, my, mz and n of each group; null for none."""
    return points.groupBy(*by).agg(*[F.avg(a).alias("m" + a) for a in "xyz"], F.count("*").alias("n"))


def centred(points: DataFrame, *by: str) -> DataFrame:
    """Points less their group's mean: an aggregate joined back, which a window would gather instead."""
    means = points.groupBy(*by).agg(*[F.avg(a).alias("m" + a) for a in "xyz"])
    joined = points.join(means, list(by)) if by else points.crossJoin(F.broadcast(means))  # one row
    for a in "xyz":
        joined = joined.withColumn(a, F.col(a) - F.col("m" + a))
    return joined.drop("mx", "my", "mz")


def second_moments(points: DataFrame, *by: str) -> DataFrame:
    """Mean products xx .. zz; nothing is centred."""
    return points.groupBy(*by).agg(*[F.avg(F.col(p[0]) * F.col(p[1])).alias(p) for p in PAIRS])


def covariance(points: DataFrame, *by: str) -> DataFrame:
    """Population covariances xx .. zz in one pass."""
    return points.groupBy(*by).agg(*[F.covar_pop(p[0], p[1]).alias(p) for p in PAIRS])


def axes(moments: DataFrame) -> DataFrame:
    """As reproduced: the "eigenvalues" are the diagonal, and the "eigenvectors" the lower triangle's rows."""
    row = lambda *c: F.struct(*[(F.col(x) if isinstance(x, str) else F.lit(0.0)).alias(n) for x, n in zip(c, "xyz", strict=True)])
    return moments.withColumn("eigenvalues", row("xx", "yy", "zz")).withColumn("e1", row("xx", 0, 0)).withColumn("e2", row("xy", "yy", 0)).withColumn("e3", row("xz", "yz", "zz"))


def principal_axes(moments: DataFrame) -> DataFrame:
    """Exact eigenvalues (descending) and unit eigenvectors of each row's symmetric matrix."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for f in frames:
            m = f[list(PAIRS)].to_numpy(float)
            full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(full) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            yield f.assign(values=pd.Series(list(values[:, ::-1]), index=f.index, dtype=object), vectors=pd.Series([x.tolist() for x in vectors[:, :, ::-1].transpose(0, 2, 1)], index=f.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema)
    return moments.mapInPandas(run, f"{fields}, values array<double>, vectors array<array<double>>")
