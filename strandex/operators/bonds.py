"""The covalent bond graph of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.operators import kernels, residues


def of_components(atoms: DataFrame, comp_bonds: DataFrame) -> DataFrame:
    """Bonds named by the definitions of other components, between atoms of one run; later rows win a repeated name."""
    runs = residues.runs(atoms)
    named = runs.groupBy("sid", "run", "name").agg(F.max("atom_idx").alias("atom_idx"))
    both = comp_bonds.select("sid", F.col("comp_id").alias("resn"), "a", "b").union(comp_bonds.select("sid", "comp_id", F.col("b"), F.col("a"))).where(~F.col("resn").isin(*C.AMINO))
    pairs = runs.select("sid", "run", "resn", F.col("name").alias("a"), F.col("atom_idx").alias("a_idx")).join(both, ["sid", "resn", "a"])
    return pairs.select("sid", "run", "a_idx", "b").join(named.select("sid", "run", F.col("name").alias("b"), F.col("atom_idx").alias("b_idx")), ["sid", "run", "b"]).where("a_idx < b_idx").select("sid", "a_idx", "b_idx").distinct()


def graph(atoms: DataFrame, scale: float = 1.0, comp_bonds: DataFrame | None = None) -> DataFrame:
    """sid, a_idx, b_idx of every bond, both ways, each once."""
    def kernel(s):
        a, b = s.bonds.T
        return {"a_idx": s.idx[a], "b_idx": s.idx[b]}

    found = kernels.per_structure(atoms, kernel, "a_idx int, b_idx int", scale)
    if comp_bonds is None:
        return found
    one = of_components(atoms, comp_bonds)
    return found.union(one).union(one.select("sid", F.col("b_idx"), F.col("a_idx"))).distinct()


def neighbours(atoms: DataFrame, graph_: DataFrame) -> DataFrame:
    """sid, atom_idx, and b_idx, b_element, b_x.. of each neighbour."""
    other = atoms.select("sid", F.col("atom_idx").alias("b_idx"), F.upper("element").alias("b_element"), *(F.col(c).alias(f"b_{c}") for c in "xyz"))
    return graph_.join(other, ["sid", "b_idx"]).withColumnRenamed("a_idx", "atom_idx")


def sole_neighbour(atoms: DataFrame, graph_: DataFrame, elements: tuple[str, ...]) -> DataFrame:
    """Atoms with exactly one neighbour of the elements, and that neighbour."""
    n = neighbours(atoms, graph_).where(F.col("b_element").isin(*elements))
    return n.groupBy("sid", "atom_idx").agg(F.count("*").alias("k"), *(F.min(c).alias(c) for c in ("b_idx", "b_x", "b_y", "b_z"))).where("k = 1").drop("k")


def apolar_carbons(atoms: DataFrame, graph_: DataFrame) -> DataFrame:
    """Carbons with at least one bond whose neighbours are all carbons."""
    only = neighbours(atoms, graph_).groupBy("sid", "atom_idx").agg(F.bool_and(F.col("b_element") == "C").alias("only")).where("only")
    return atoms.where(F.upper("element") == "C").join(only.select("sid", "atom_idx"), ["sid", "atom_idx"], "left_semi")
