"""Geometry over points as struct<x,y,z> columns; everything compiles to JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Virtual C-beta as a combination of the backbone's cross product and two bonds.
CB_CROSS, CB_NORMAL, CB_BOND = -0.58273431, 0.56802827, -0.54067466
EPSILON = 1e-10


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def point(x, y, z) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in zip((x, y, z), "xyz", strict=True)])


def _map(a: Column, b: Column, f) -> Column:
    return F.struct(*[f(a[c], b[c]).alias(c) for c in "xyz"])


def add(a: Column, b: Column) -> Column:
    return _map(a, b, lambda p, q: p + q)


def minus(a: Column, b: Column) -> Column:
    return _map(a, b, lambda p, q: p - q)


def scaled(a: Column, k) -> Column:
    return F.struct(*[(a[c] * k).alias(c) for c in "xyz"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct(
        (a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
        (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
        (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"),
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for a vector of no length."""
    return let(a, lambda v: F.when(norm(v) > 0, F.struct(*[(v[c] / norm(v)).alias(c) for c in "xyz"])))


def squared_distance(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def plane_distance(p: Column, origin: Column, normal: Column) -> Column:
    """Signed distance of p from the plane through origin."""
    return dot(minus(p, origin), unit(normal))


def halfspace(p: Column, origin: Column, normal: Column) -> Column:
    """1, 0 or -1: the side of the plane, 0 within EPSILON of it."""
    d = plane_distance(p, origin, normal)
    return F.when(F.abs(d) < EPSILON, 0).when(d > 0, 1).otherwise(-1)


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def tetrahedron_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed."""
    return dot(minus(a, d), cross(minus(b, d), minus(c, d))) / 6


def line_distance(p: Column, a: Column, b: Column) -> Column:
    """Of p from the line through a and b; null if they coincide."""
    return F.when(norm(minus(b, a)) > 0, F.try_divide(norm(cross(minus(b, a), minus(p, a))), norm(minus(b, a))))


def spherical_triangle_area(a: Column, b: Column, c: Column, radius) -> Column:
    """Of the triangle that the directions a, b and c cut out of a sphere around the origin."""
    units = F.struct(unit(a).alias("u"), unit(b).alias("v"), unit(c).alias("w"))

    def solid(e: Column) -> Column:
        u, v, w = e["u"], e["v"], e["w"]
        return 2 * F.atan2(F.abs(dot(u, cross(v, w))), 1 + dot(u, v) + dot(v, w) + dot(w, u))

    return let(units, solid) * radius * radius


def angle(a: Column, b: Column, c: Column) -> Column:
    """At b, in radians; the cosine is clipped, and null stands for an undefined angle."""
    u, v = unit(minus(a, b)), unit(minus(c, b))
    clipped = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    return let(dot(u, v), lambda c: F.when(c.isNotNull(), clipped(c)))  # greatest and least would pass nulls over


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """In radians, -pi to pi."""
    ends = F.struct(unit(minus(c, b)).alias("axis"), minus(a, b).alias("back"), minus(d, c).alias("ahead"))

    def around(e: Column) -> Column:
        v, w = (minus(e[end], scaled(e["axis"], dot(e[end], e["axis"]))) for end in ("back", "ahead"))
        return let(
            F.struct(e["axis"].alias("axis"), v.alias("v"), w.alias("w")),
            lambda x: F.atan2(dot(cross(x["axis"], x["v"]), x["w"]), dot(x["v"], x["w"])),
        )

    return let(ends, around)


def virtual_cb(n: Column, ca: Column, c: Column) -> Column:
    b, e = minus(ca, n), minus(c, ca)
    return add(add(add(scaled(cross(b, e), CB_CROSS), scaled(b, CB_NORMAL)), scaled(e, CB_BOND)), ca)


def local_frame(n: Column, ca: Column, cb: Column) -> Column:
    """struct<x, y, z> of three unit vectors at right angles: z from CA to CB, x across the bond from N to CA and z; null where they lie on one line."""

    def across(z: Column) -> Column:
        return let(unit(cross(minus(ca, n), z)), lambda x: F.when(x.isNotNull(), F.struct(x.alias("x"), unit(cross(z, x)).alias("y"), z.alias("z"))))

    return let(unit(minus(cb, ca)), across)


def in_frame(p: Column, origin: Column, frame: Column) -> Column:
    """p as seen from the origin along the frame's axes."""
    return let(minus(p, origin), lambda v: F.struct(*[dot(frame[c], v).alias(c) for c in "xyz"]))


def rotated(p: Column, axis: Column, radians) -> Column:
    """p turned around an axis through the origin."""
    cos, sin = F.cos(radians), F.sin(radians)
    return let(unit(axis), lambda k: add(add(scaled(p, cos), scaled(cross(k, p), sin)), scaled(k, dot(k, p) * (1 - cos))))


def sphere_gap(a: Column, ra, b: Column, rb) -> Column:
    """Between two surfaces; negative where they overlap."""
    return distance(a, b) - ra - rb


def spheres_intersect(a: Column, ra, b: Column, rb) -> Column:
    return sphere_gap(a, ra, b, rb) < 0


def spheres_touch(a: Column, ra, b: Column, rb) -> Column:
    return F.abs(sphere_gap(a, ra, b, rb)) < EPSILON


def sphere_contains(a: Column, ra, b: Column, rb) -> Column:
    """Whether sphere a holds all of b."""
    return distance(a, b) + rb <= ra


def quadratic_roots(a, b, c) -> Column:
    """Real roots of a x^2 + b x + c, ascending; a is not 0. The larger root comes first to avoid cancellation."""
    d = b * b - 4 * a * c
    q = F.when(b >= 0, -b - F.sqrt(d)).otherwise(-b + F.sqrt(d)) / 2
    pair = F.array_sort(F.array(q / a, F.when(q != 0, F.try_divide(c, q)).otherwise(F.lit(0.0))))
    return F.when(d < 0, F.array().cast("array<double>")).when(d == 0, F.array(-b / (2 * a))).otherwise(pair)


def intersection_circle(a: Column, ra: Column, b: Column, rb: Column) -> Column:
    """struct<radius, circumference, angle> of the circle that two spheres share, the angle being its half opening seen from a; null if they don't meet."""

    def circle(d: Column) -> Column:
        offset = F.try_divide(d * d + ra * ra - rb * rb, 2 * d)
        radius = F.sqrt(F.greatest(ra * ra - offset * offset, F.lit(0.0)))
        meets = (d > 0) & (d <= ra + rb) & (d >= F.abs(ra - rb))
        return F.when(meets, F.struct(radius.alias("radius"), (2 * F.pi() * radius).alias("circumference"), F.atan2(radius, offset).alias("angle")))

    return let(distance(a, b), circle)
