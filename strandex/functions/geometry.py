"""Vectors as struct<x,y,z> columns, and the angles and energies made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandex import constants as C


def let(value: Column, f) -> Column:
    """f of a value that is computed once, so that formulas built on formulas stay small."""
    return F.transform(F.array(value), f)[0]


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def at(prefix: str = "", scale: float = 1.0) -> Column:
    """The position in columns <prefix>x, y, z, in ångström."""
    return vec(*(F.col(f"{prefix}{c}") / F.lit(float(scale)) for c in "xyz"))


def _each(a: Column, b: Column, f) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: vec(*(f(s["a"][c], s["b"][c]) for c in "xyz")))


def add(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: p + q)


def sub(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: p - q)


def times(a: Column, k) -> Column:
    return let(a, lambda v: vec(*(v[c] * k for c in "xyz")))


def dot(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: s["a"]["x"] * s["b"]["x"] + s["a"]["y"] * s["b"]["y"] + s["a"]["z"] * s["b"]["z"])


def cross(a: Column, b: Column) -> Column:
    def of(s):
        a, b = s["a"], s["b"]
        return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for a vector without a direction."""
    return let(a, lambda v: let(length(v), lambda n: F.when(n > 1e-6, times(v, 1 / n))))


def distance2(a: str, b: str) -> Column:
    """Squared distance between columns <a>x.. and <b>x.., in their own unit."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))


def angle_at(v: Column, a: Column, b: Column) -> Column:
    """Degrees between a and b seen from v; 0 where a direction is missing."""
    def of(s):
        n = length(s["p"]) * length(s["q"])
        return F.when(n > 1e-12, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(s["p"], s["q"]) / n))))).otherwise(0.0)

    return let(v, lambda w: let(F.struct(sub(a, w).alias("p"), sub(b, w).alias("q")), of))


def plane_angle(n: Column, m: Column) -> Column:
    """Degrees between two planes, 0 to 90."""
    return let(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(n, m))))), lambda a: F.least(a, 180.0 - a))


def planar_offset(q: Column, c: Column, n: Column) -> Column:
    """How far q, projected on the plane through c with normal n, is from c."""
    return let(sub(q, c), lambda d: length(sub(d, times(n, dot(d, n)))))


def strictly_within(x: Column, lo: float, hi: float) -> Column:
    return (x > lo) & (x < hi)


def bond_energy(o: Column, c: Column, n: Column, h: Column) -> Column:
    """Energy (kcal/mol) of a backbone hydrogen bond of C=O with N-H: 0 for coinciding atoms, floored."""
    r = F.array(*(length(sub(a, b)) for a, b in ((o, n), (c, h), (o, h), (c, n))))
    return let(r, lambda r: F.when(F.array_min(r) < C.DSSP_SAME, 0.0).otherwise(F.greatest(C.DSSP_FACTOR * (1 / r[0] + 1 / r[1] - 1 / r[2] - 1 / r[3]), F.lit(C.DSSP_FLOOR))))


def outward(d: Column, neighbours: Column) -> Column:
    """A hydrogen of d away from an array of neighbour positions; null where they cancel out."""
    total = F.aggregate(neighbours, vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda a, p: add(a, F.coalesce(unit(sub(p, d)), vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))))
    return sub(d, times(unit(total), C.BOND_H))


def planar_pair(d: Column, p: Column, q: Column) -> Column:
    """The two hydrogens of d in the plane of its neighbour p and second neighbour q."""
    import math

    half = math.radians(C.SP2 / 2)

    def of(s):
        middle = add(d, times(s["b"], math.cos(half)))
        pair = F.array(add(middle, times(s["side"], math.sin(half))), sub(middle, times(s["side"], math.sin(half))))
        return F.when(s["side"]["x"].isNotNull(), pair)

    normal = unit(cross(sub(d, p), sub(q, p)))
    return let(unit(sub(d, p)), lambda b: let(F.struct(b.alias("b"), cross(normal, b).alias("side")), of))


def straddling_pair(d: Column, a: Column, b: Column) -> Column:
    """The two hydrogens of d on either side of the plane of its neighbours a and b."""
    import math

    half = math.radians(C.HXH / 2)

    def of(s):
        middle = add(d, times(s["w"], math.cos(half)))
        pair = F.array(add(middle, times(s["n"], math.sin(half))), sub(middle, times(s["n"], math.sin(half))))
        return F.when(s["w"]["x"].isNotNull() & s["n"]["x"].isNotNull(), pair)

    return let(F.struct(unit(sub(outward(d, F.array(a, b)), d)).alias("w"), unit(cross(sub(a, d), sub(b, d))).alias("n")), of)


def rotor_toward(d: Column, antecedent: Column, target: Column) -> Column:
    """The place on the circle of a rotatable hydrogen of d that is nearest to a target."""
    import math

    along, radius = -math.cos(math.radians(C.SP3)), math.sin(math.radians(C.SP3))

    def of(axis):
        off = let(sub(target, d), lambda to: unit(sub(to, times(axis, dot(to, axis)))))
        # a target on the axis sees every place of the circle alike
        aside = unit(cross(axis, F.when(F.abs(axis["x"]) < 0.9, vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(vec(F.lit(0.0), F.lit(1.0), F.lit(0.0)))))
        return F.when(axis["x"].isNotNull(), add(d, times(add(times(axis, along), times(F.coalesce(off, aside), radius)), C.BOND_H)))

    return let(unit(sub(d, antecedent)), of)


def newell_normal(points: Column) -> Column:
    """Unit normal of a ring given as an array of positions in ring order."""
    n = F.size(points)
    pairs = F.transform(points, lambda p, i: F.struct(p.alias("p"), F.element_at(points, (i + 1) % n + 1).alias("q")))
    start = vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    total = F.aggregate(pairs, start, lambda a, r: vec(a["x"] + (r["p"]["y"] - r["q"]["y"]) * (r["p"]["z"] + r["q"]["z"]), a["y"] + (r["p"]["z"] - r["q"]["z"]) * (r["p"]["x"] + r["q"]["x"]), a["z"] + (r["p"]["x"] - r["q"]["x"]) * (r["p"]["y"] + r["q"]["y"])))
    return unit(total)
