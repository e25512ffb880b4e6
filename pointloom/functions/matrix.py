"""Square matrices as lists of rows of Columns, unrolled so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vector as v

Matrix = list[list[Column]]


def matrix(rows) -> Matrix:
    return [[v.col(x) for x in r] for r in rows]


def pack(m: Matrix) -> Column:
    return F.array(*[F.array(*r) for r in m])


def unpack(c: Column, n: int) -> Matrix:
    return [[F.get(F.get(c, F.lit(i)), F.lit(j)) for j in range(n)] for i in range(n)]


def identity(n: int) -> Matrix:
    return matrix([[float(i == j) for j in range(n)] for i in range(n)])


def zero(n: int) -> Matrix:
    return matrix([[0.0] * n for _ in range(n)])


def add(a: Matrix, b: Matrix) -> Matrix:
    return [[x + y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def sub(a: Matrix, b: Matrix) -> Matrix:
    return [[x - y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def scale(a: Matrix, s) -> Matrix:
    return [[x * v.col(s) for x in r] for r in a]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return [[v.dot(tuple(r), c) for c in columns] for r in a]


def apply(a: Matrix, x: v.Vector) -> v.Vector:
    """Matrix times column vector."""
    return tuple(v.dot(tuple(r), x) for r in a)


def transpose(a: Matrix) -> Matrix:
    return [list(c) for c in zip(*a, strict=True)]


def _minor(a: Matrix, i: int, j: int) -> Matrix:
    return [[x for k, x in enumerate(r) if k != j] for m, r in enumerate(a) if m != i]


def determinant(a: Matrix) -> Column:
    if len(a) == 1:
        return a[0][0]
    out = None
    for j, x in enumerate(a[0]):
        term = x * determinant(_minor(a, 0, j))
        out = term if out is None else (out - term if j % 2 else out + term)
    return out


def inverse(a: Matrix) -> Matrix:
    """Adjugate over determinant; singular (below the float epsilon) gives the identity."""
    n, det = len(a), determinant(a)
    singular = F.abs(det) < v.FLOAT_EPSILON
    one = identity(n)
    return [[F.when(singular, one[i][j]).otherwise(F.try_divide(determinant(_minor(a, j, i)) * float((-1) ** (i + j)), det)) for j in range(n)] for i in range(n)]


def inverse4(a: Matrix) -> Matrix:
    """As reproduced: row 0 of the inverse, and the identity's other rows."""
    return [inverse(a)[0], *identity(4)[1:]]


def transform_point(a: Matrix, p: v.Vector) -> v.Vector:
    """Row-vector convention, translation in row 3."""
    return tuple(v.dot(p, tuple(a[i][j] for i in range(3))) + a[3][j] for j in range(3))


def transform_vector(a: Matrix, p: v.Vector) -> v.Vector:
    """As reproduced: column-vector convention."""
    return tuple(v.dot(tuple(a[i][:3]), p) for i in range(3))


def transform_vector_exact(a: Matrix, p: v.Vector) -> v.Vector:
    """The convention of transform_point."""
    return tuple(v.dot(p, tuple(a[i][j] for i in range(3))) for j in range(3))


def translate(a: Matrix, t: v.Vector) -> Matrix:
    """The matrix times a translation in row 3."""
    move = identity(4)
    move[3][:3] = list(t)
    return multiply(a, move)


def instance(position: v.Vector, size) -> Matrix:
    """Diagonal scale with the translation in row 3."""
    m = matrix([[float(i == j) for j in range(4)] for i in range(4)])
    for i in range(3):
        m[i][i] = v.col(size)
        m[3][i] = position[i]
    return m
