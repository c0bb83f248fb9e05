"""Role predicates of atoms as boolean columns over resn, name, element, is_hetatm."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex import constants as C


def _c(name: str, prefix: str) -> Column:
    return F.col(prefix + name)


def _element(prefix: str) -> Column:
    return F.upper(_c("element", prefix))


def water(prefix: str = "") -> Column:
    return _c("resn", prefix).isin(*C.WATER)


def metal(prefix: str = "") -> Column:
    return F.coalesce(_element(prefix).isin(*C.METALS), F.lit(False))


def water_oxygen(prefix: str = "") -> Column:
    return water(prefix) & (_element(prefix) == "O")


def cysteine_sulfur(prefix: str = "") -> Column:
    return (_c("resn", prefix) == "CYS") & (_c("name", prefix) == "SG")


def metal_donor(prefix: str = "") -> Column:
    """Water oxygens, any atom named O or OXT, and the binding side-chain atoms."""
    side = reduce(or_, ((_c("resn", prefix) == r) & _c("name", prefix).isin(*n) for r, n in C.METAL_DONORS.items()))
    return water_oxygen(prefix) | _c("name", prefix).isin("O", "OXT") | side


def standard(prefix: str = "") -> Column:
    return _c("resn", prefix).isin(*C.AMINO)


def nucleic(prefix: str = "") -> Column:
    return _c("resn", prefix).isin(*C.NUCLEOTIDES)


def ligand(prefix: str = "") -> Column:
    return _c("is_hetatm", prefix) & ~water(prefix) & ~metal(prefix)


def bears_surface(prefix: str = "") -> Column:
    return ~_c("is_hetatm", prefix) & ~_element(prefix).eqNullSafe("H")


def acceptors(atoms: DataFrame, comp_roles: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Hydrogen-bond acceptors: every O of a standard residue and HIS nitrogens, never water; else what the component's definition allows, but no nitrogen with a bond beyond it.

    ``comp_roles``: sid, comp_id, atom_name, accepts, n_bonds (heavy neighbours by definition).
    """
    plain = atoms.where(standard() & ((F.upper("element") == "O") | ((F.col("resn") == "HIS") & F.col("name").isin("ND1", "NE2"))))
    if comp_roles is None:
        return plain
    other = atoms.where(~standard() & ~water()).join(comp_roles.where("accepts").select("sid", F.col("comp_id").alias("resn"), F.col("atom_name").alias("name"), "n_bonds"), ["sid", "resn", "name"])
    if graph is not None:
        degree = graph.groupBy("sid", F.col("a_idx").alias("atom_idx")).agg(F.count("*").alias("degree"))
        other = other.join(degree, ["sid", "atom_idx"], "left").where("not (upper(element) = 'N' and coalesce(degree, 0) > n_bonds)")
    return plain.unionByName(other.select(*atoms.columns))


def ligand_residues(atoms: DataFrame) -> DataFrame:
    """Residues of hetero atoms that are not water (metals count)."""
    return atoms.where(F.col("is_hetatm") & ~water()).select("sid", "chain", "resi", "icode").distinct()
