"""Vectors as tuples of Columns. `pack3` and `pack4` make structs, `parts` takes them apart.

Doubles throughout. Where the reproduced behaviour is mathematically odd, `*_exact` is the correct one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_EPSILON = 1.1920928955078125e-07
FLOAT_MAX = 3.402823466e36
Vector = tuple[Column, ...]
PI, DEG2RAD, RAD2DEG = math.pi, math.pi / 180.0, 180.0 / math.pi
NAN, INFINITY = float("nan"), float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(*xs) -> Vector:
    return tuple(col(x) for x in xs)


def parts(c: Column, names: str = "xyz") -> Vector:
    return tuple(c[n] for n in names)


def pack(v: Vector, names: str | None = None) -> Column:
    names = names or "xyzw"[: len(v)]
    return F.struct(*[x.alias(n) for x, n in zip(v, names, strict=True)])


def from_array(a: Column, n: int = 3, start: int = 0) -> Vector:
    return tuple(F.get(a, F.lit(start + i)).cast("double") for i in range(n))


def unit(axis: str | None = None, n: int = 4) -> Vector:
    """The unit vector of an axis of xyzw; zeros for None, ones for "one"."""
    return vec(*[float(axis == "one" or "xyzw"[i] == axis) for i in range(n)])


def _pairwise(f):
    def op(a: Vector, b) -> Vector:
        b = b if isinstance(b, tuple) else (col(b),) * len(a)
        return tuple(f(x, y) for x, y in zip(a, b, strict=True))

    return op


add = _pairwise(lambda x, y: x + y)
sub = _pairwise(lambda x, y: x - y)
mul = _pairwise(lambda x, y: x * y)
#: Division by zero gives null rather than an error.
div = _pairwise(lambda x, y: F.try_divide(x, y))


def neg(a: Vector) -> Vector:
    return tuple(-x for x in a)


def scalar_minus(s, a: Vector) -> Vector:
    """As reproduced: the vector minus the scalar."""
    return sub(a, s)


def scalar_minus_exact(s, a: Vector) -> Vector:
    return tuple(col(s) - x for x in a)


def scalar_over(s, a: Vector) -> Vector:
    """As reproduced: the vector over the scalar."""
    return div(a, s)


def scalar_over_exact(s, a: Vector) -> Vector:
    return tuple(F.try_divide(col(s), x) for x in a)


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> Vector:
    return tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))


def magnitude(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return magnitude(sub(a, b))


def normalize(a: Vector) -> Vector:
    """Unit length; a zero vector is itself."""
    m = magnitude(a)
    return tuple(F.when(m != 0, F.try_divide(x, m)).otherwise(x) for x in a)


def normalize4(a: Vector) -> Vector:
    """Unit length; below the float epsilon, the zero vector."""
    m = magnitude(a)
    return tuple(F.when(m < FLOAT_EPSILON, F.lit(0.0)).otherwise(F.try_divide(x, m)) for x in a)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, col(low)), col(high))


def angle(a: Vector, b: Vector) -> Column:
    """acos of the clamped dot product; inputs are taken as they are."""
    return F.acos(clamp(dot(a, b), -1, 1))


def angle_exact(a: Vector, b: Vector) -> Column:
    return angle(normalize(a), normalize(b))


def greatest3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(a, b, c)


def least3(a: Column, b: Column, c: Column) -> Column:
    return F.least(a, b, c)


def valid(a: Vector) -> Column:
    """All components below the sentinel; NaN and +inf are not, -inf is."""
    out = a[0] < FLOAT_MAX
    for x in a[1:]:
        out = out & (x < FLOAT_MAX)
    return out


def line_plane(l0: Vector, l1: Vector, position: Vector, normal: Vector) -> Vector:
    """Where the line through l0 and l1 meets the plane; NaN if parallel."""
    d = sub(l1, l0)
    across = dot(d, normal)
    t = F.try_divide(dot(sub(position, l0), normal), across)
    return tuple(F.when(across == 0, F.lit(float("nan"))).otherwise(a + t * b) for a, b in zip(l0, d, strict=True))


def orbit_eye(target: Vector, radius, azimuth, elevation) -> Vector:
    """Eye on a sphere about the target; angles in degrees."""
    a, e = F.radians(col(azimuth)), F.radians(col(elevation))
    return add(target, mul((F.cos(e) * F.sin(a), F.sin(e), F.cos(e) * F.cos(a)), col(radius)))


#: Vector keywords (fixed values).
KEYWORDS = {
    "nan": (float("nan"),) * 3,
    "zero": (0, 0, 0),
    "one": (1, 1, 1),
    "half": (0.5, 0.5, 0.5),
    "red": (1, 0, 0),
    "green": (0, 1, 0),
    "blue": (0, 0, 1),
    "black": (0, 0, 0),
    "gray": (0.5, 0.5, 0.5),
    "white": (1, 1, 1),
    "yellow": (1, 1, 0),
    "magenta": (1, 0, 1),
    "cyan": (0, 1, 1),
    "positive x": (1, 0, 0),
    "positive y": (0, 1, 0),
    "positive z": (0, 0, 1),
    "negative x": (-1, 0, 0),
    "negative y": (0, -1, 0),
    "negative z": (0, 0, -1),
}


def keyword(word: Column, n: int = 3) -> Vector:
    """The vector that a keyword (any case) or a number names; unknown words give zeros.

    Vectors of 2 or 4 components know nan, zero, one, half and numbers only."""
    word = F.lower(word)
    number = word.try_cast("double") if hasattr(word, "try_cast") else F.expr("null")
    known = KEYWORDS if n == 3 else {k: (v[0],) * n for k, v in list(KEYWORDS.items())[:4]}
    out = []
    for i in range(n):
        c = F.when(F.lit(False), F.lit(0.0))
        for k, v in known.items():
            c = c.when(word == k, F.lit(float(v[i])))
        out.append(c.otherwise(F.coalesce(number, F.lit(0.0))))
    return tuple(out)


def shown(v: Vector) -> Column:
    """(x, y, z) as text."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[six_digits(x) for x in v]), F.lit(")"))


def six_digits(x: Column) -> Column:
    """A double in six significant digits without trailing zeros, as C++ streams print it.

    An Arrow UDF: Java's formatter rounds the shortest decimal form, C the exact binary value."""
    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) and n else "%g" % v for v, n in zip(values, values.isna(), strict=True)], dtype=object)

    number = x.cast("double")
    return F.when(F.isnan(number), F.lit("nan")).otherwise(shown(number))
