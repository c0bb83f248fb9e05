"""Residues from atom rows: contiguous runs, keys, conformers, traces, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions.geometry import distance2

#: The full residue key; icode may be null, so joins on it are null-safe.
KEY = ("chain", "resi", "icode")


def same_residue(a: str, b: str) -> Column:
    """a_ and b_ prefixed columns of one structure belong to one residue."""
    return (F.col(f"{a}chain") == F.col(f"{b}chain")) & (F.col(f"{a}resi") == F.col(f"{b}resi")) & F.col(f"{a}icode").eqNullSafe(F.col(f"{b}icode"))


def key_join(a: DataFrame, b: DataFrame, how: str = "inner", left: str = "", right: str = "r_") -> DataFrame:
    """Join on structure and residue; b's key columns carry the prefix ``right``."""
    on = F.col(f"{left}sid") == F.col(f"{right}sid")
    for c in KEY:
        on = on & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return a.join(b, on, how)


def runs(atoms: DataFrame) -> DataFrame:
    """Add ``run``: the number of the contiguous stretch of equal residue keys, from 0 in each structure."""
    w = Window.partitionBy("sid").orderBy("atom_idx")
    key = F.struct(*KEY)
    new = (~F.lag(key).over(w).eqNullSafe(key)).cast("long")
    return atoms.withColumn("run", (F.sum(F.coalesce(new, F.lit(1))).over(w) - 1).cast("long"))


def altloc(atoms: DataFrame, policy: str = "occupancy") -> DataFrame:
    """Alternate locations: 'all', 'A', 'B', or one label for each residue by occupancy.

    The label with the largest summed occupancy wins, the backbone's sum where
    it has labels; ties go to the earlier label.  An atom that only other labels
    have keeps its most occupied copy.  A kept atom takes the place (atom_idx)
    of the first copy.
    """
    if policy == "all":
        return atoms
    if policy in ("A", "B"):
        return atoms.where(F.col("altloc").isNull() | (F.col("altloc") == policy))
    labelled = atoms.where("altloc is not null")
    backbone = F.when(F.col("name").isin(*C.BACKBONE), F.col("occupancy"))
    sums = labelled.groupBy("sid", *KEY, "altloc").agg(F.round(F.sum("occupancy"), 6).alias("all_sum"), F.round(F.sum(backbone), 6).alias("bb_sum"))
    residue = Window.partitionBy("sid", *KEY)
    has = F.max("bb_sum").over(residue).isNotNull()
    weight = F.when(has, F.col("bb_sum")).otherwise(F.col("all_sum"))
    ranked = sums.withColumn("weight", weight).where("weight is not null").groupBy("sid", *KEY).agg(F.min_by("altloc", F.struct(-F.col("weight"), F.col("altloc"))).alias("r_label"))
    ranked = ranked.select(F.col("sid").alias("r_sid"), *(F.col(c).alias(f"r_{c}") for c in KEY), "r_label")
    copies = Window.partitionBy("sid", *KEY, "name")
    best = copies.orderBy((F.col("altloc") != F.col("r_label")).cast("int"), F.desc("occupancy"), "altloc", "atom_idx")
    joined = key_join(labelled, ranked).withColumn("place", F.min("atom_idx").over(copies)).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    chosen = joined.withColumn("atom_idx", F.col("place")).select(*atoms.columns)
    return atoms.where("altloc is null").unionByName(chosen)


def calpha_trace(atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    """Consecutive C-alpha pairs: one chain, number + 1, at a bond-like distance."""
    w = Window.partitionBy("sid").orderBy("atom_idx")
    ca = atoms.where("name = 'CA'").select("sid", "chain", F.col("resi").alias("a_resi"), F.col("atom_idx").alias("a_idx"), *(F.col(c).alias(f"a_{c}") for c in "xyz"))
    after = ca.withColumns({"b_idx": F.lead("a_idx").over(w.orderBy("a_idx")), "b_chain": F.lead("chain").over(w.orderBy("a_idx")), "b_resi": F.lead("a_resi").over(w.orderBy("a_idx")), **{f"b_{c}": F.lead(f"a_{c}").over(w.orderBy("a_idx")) for c in "xyz"}})
    lo, hi = ((v * scale) ** 2 for v in C.CALPHA)
    return after.where((F.col("chain") == F.col("b_chain")) & (F.col("b_resi") == F.col("a_resi") + 1)).withColumn("d2", distance2("a_", "b_")).where((F.col("d2") >= lo) & (F.col("d2") <= hi)).select("sid", "chain", "a_resi", "b_resi", "a_idx", "b_idx", "d2")


def depth_slab(atoms: DataFrame, far: float, near: float, depth: Column | str = "z") -> DataFrame:
    """Atoms whose depth, as a share of their structure's range from the least (0) to the largest (1), lies between far and near."""
    depth = F.col(depth) if isinstance(depth, str) else depth
    whole = Window.partitionBy("sid")
    least, most = F.min(depth).over(whole), F.max(depth).over(whole)
    return atoms.withColumn("slab", F.when(most > least, (depth - least) / (most - least)).otherwise(0.0)).where((F.col("slab") >= far) & (F.col("slab") <= near)).drop("slab")


def bfactor_range(atoms: DataFrame) -> DataFrame:
    """2 % and 98 % of each structure's B-factors, taken at index trunc(n * p); NaN doesn't count; (0, 100) without values."""
    w = Window.partitionBy("sid")
    good = atoms.where("b_factor is not null and not isnan(b_factor)").select("sid", "b_factor", (F.row_number().over(w.orderBy("b_factor")) - 1).alias("at"), F.count("*").over(w).alias("n"))
    found = good.groupBy("sid").agg(*(F.max(F.when(F.col("at") == F.floor(F.col("n") * p), F.col("b_factor"))).alias(name) for p, name in ((0.02, "low"), (0.98, "high"))))
    return atoms.select("sid").distinct().join(found, "sid", "left").select("sid", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(100.0)).alias("high"))


def extents(atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    """Unweighted centre and bounds of each structure."""
    return atoms.groupBy("sid").agg(*(F.round(F.avg(c) / scale, 4).alias(f"center_{c}") for c in "xyz"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))
