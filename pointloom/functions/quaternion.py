"""Quaternions (w, x, y, z) as tuples of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vector as v

Quaternion = tuple[Column, Column, Column, Column]


def about(radian, axis: v.Vector) -> Quaternion:
    """A turn about an axis, which is taken as it is."""
    half = v.col(radian) / 2
    return (F.cos(half), *v.mul(axis, F.sin(half)))


def identity() -> Quaternion:
    """As reproduced: (0, 0, 0, 1), which is not the neutral element."""
    return v.vec(0, 0, 0, 1)


def identity_exact() -> Quaternion:
    return v.vec(1, 0, 0, 0)


def zero() -> Quaternion:
    return v.vec(0, 0, 0, 0)


def conjugate(q: Quaternion) -> Quaternion:
    return (q[0], *v.neg(q[1:]))


def product(a: Quaternion, b: Quaternion) -> Quaternion:
    """Hamilton's: scalar part w w' - u.u', vector part w u' + w' u + u x u'."""
    u = v.add(v.add(v.mul(b[1:], a[0]), v.mul(a[1:], b[0])), v.cross(a[1:], b[1:]))
    return (a[0] * b[0] - v.dot(a[1:], b[1:]), *u)


def rotate(p: v.Vector, q: Quaternion) -> v.Vector:
    once = v.cross(q[1:], p)
    return v.add(p, v.mul(v.add(v.mul(once, q[0]), v.cross(q[1:], once)), 2.0))


def between(a: v.Vector, b: v.Vector) -> Quaternion:
    """The turn from a to b: none when nearly parallel, half a turn when nearly opposite."""
    a, b = v.normalize(a), v.normalize(b)
    d = v.dot(a, b)
    flat = F.abs(a[0]) > F.abs(a[2])
    zero = F.lit(0.0)
    side = v.normalize((F.when(flat, -a[1]).otherwise(zero), F.when(flat, a[0]).otherwise(-a[2]), F.when(flat, zero).otherwise(a[1])))
    usual = about(F.acos(v.clamp(d, -1, 1)), v.normalize(v.cross(a, b)))
    same, opposite = identity_exact(), (zero, *side)
    return tuple(F.when(d > 0.9999, s).when(d < -0.9999, o).otherwise(u) for s, o, u in zip(same, opposite, usual, strict=True))
