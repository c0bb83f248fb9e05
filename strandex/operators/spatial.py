"""Radius joins as hash joins on grid cells.

A distance predicate alone plans as a nested loop.  Here both sides get the
cell of an edge of the radius, one side is copied into the 27 cells around its
own, and the join is an equi-join on (sid, cell) with the exact distance as the
rest.  Work then follows the number of neighbours, and joins of all structures
run as one shuffle by structure and cell, which no structure can dominate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions.geometry import distance2

STEPS = (-1, 0, 1)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _cells(df: DataFrame, prefix: str, size: float) -> dict[str, Column]:
    return {f"{prefix}c{c}": F.floor(F.col(f"{prefix}{c}") / F.lit(float(size))).cast("long") for c in "xyz"}


def radius_join(a: DataFrame, b: DataFrame, radius: float, scale: float = 1.0, where: Column | None = None) -> DataFrame:
    """All pairs of rows of one ``sid`` at most ``radius`` ångström apart, with a_ and b_ columns and d2.

    Both sides have sid, x, y, z in units of 1/scale ångström.  b is the side
    that is copied: give the smaller one.  d2 is in squared units.
    """
    reach = (radius or 1.0) * scale
    left = prefixed(a, "a_")
    left = left.withColumns(_cells(left, "a_", reach))
    right = prefixed(b, "b_")
    right = right.withColumns(_cells(right, "b_", reach))
    offsets = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip("xyz", (i, j, k), strict=True))) for i in STEPS for j in STEPS for k in STEPS))
    right = right.withColumn("step", F.explode(offsets)).withColumns({f"b_c{c}": F.col(f"b_c{c}") + F.col(f"step.{c}") for c in "xyz"}).drop("step")
    on = (F.col("a_sid") == F.col("b_sid")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & (F.col("a_cz") == F.col("b_cz"))
    near = distance2("a_", "b_") <= F.lit(int(round(radius * scale)) ** 2 if scale != 1 else radius * radius)
    pairs = left.join(right, on & near if where is None else on & near & where)
    return pairs.withColumn("d2", distance2("a_", "b_")).drop(*(f"{p}c{c}" for p in ("a_", "b_") for c in "xyz"))


def radius_semi_join(a: DataFrame, b: DataFrame, radius: float, scale: float = 1.0) -> DataFrame:
    """Rows of a (keyed by sid and atom_idx) within ``radius`` of any row of b; rows of b themselves are within."""
    hit = radius_join(a.select("sid", "atom_idx", "x", "y", "z"), b.select("sid", "x", "y", "z"), radius, scale).select(F.col("a_sid").alias("sid"), F.col("a_atom_idx").alias("atom_idx")).distinct()
    return a.join(hit, ["sid", "atom_idx"], "left_semi")


def gate(lo: float, hi: float, scale: float = 1.0) -> Column:
    """lo < distance < hi on d2, exact for integer coordinates."""
    square = (lambda v: int(round(v * scale)) ** 2) if scale != 1 else (lambda v: v * v)
    return (F.col("d2") > F.lit(square(lo))) & (F.col("d2") < F.lit(square(hi)))


def angstrom(scale: float = 1.0) -> Column:
    return F.sqrt(F.col("d2").cast("double")) / F.lit(float(scale))
