"""Agreement with reference answers: labels, values, sets; macro and micro summaries; gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import scalars
from strandex.operators import residues

_EDGE = ("sid", "kind", "source", "target")


def q3(predicted: str, reference: str) -> Column:
    """Share of equal states; null for no rows."""
    return F.avg((F.col(predicted) == F.col(reference)).cast("double"))


def error_stats(predicted: str, reference: str) -> dict[str, Column]:
    """Mean and median absolute error, and Pearson's r (0 without variance)."""
    off = F.abs(F.col(predicted) - F.col(reference))
    return {"mae": F.avg(off), "median_error": F.median(off), "pearson": F.coalesce(F.corr(predicted, reference), F.lit(0.0))}


def set_agreement(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """sid, kind, counts, precision, recall, f1 of edge sets (sid, kind, source, target, unordered pairs given in one order).

    An empty set scores 1 against an empty one and 0 against others; ``vacuous``
    marks the first, so that means can be taken with or without it.
    """
    mark = lambda df, name: df.select(*_EDGE).distinct().withColumn(name, F.lit(1))
    both = mark(predicted, "p").join(mark(reference, "r"), list(_EDGE), "full")
    n = both.groupBy("sid", "kind").agg(F.count("p").alias("n_predicted"), F.count("r").alias("n_reference"), F.sum(F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), 1).otherwise(0)).alias("n_common"))
    return scored(n)


def scored(counts: DataFrame) -> DataFrame:
    share = lambda of, other: F.when(F.col(of) == 0, (F.col(other) == 0).cast("double")).otherwise(F.col("n_common") / F.col(of))
    p, r = share("n_predicted", "n_reference"), share("n_reference", "n_predicted")
    return counts.withColumns({"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "vacuous": (F.col("n_predicted") == 0) & (F.col("n_reference") == 0)})


def residue_pairs(found: DataFrame, atoms: DataFrame) -> DataFrame:
    """Contacts as distinct unordered residue pairs of each kind."""
    from strandex.operators import network

    return network.edges(found, atoms).select(*_EDGE)


def near_ligands(edges: DataFrame, ligands: DataFrame) -> DataFrame:
    """Edges of which an end is a ligand residue."""
    ids = ligands.select("sid", scalars.node_id(*map(F.col, residues.KEY)).alias("id")).distinct()
    hit = edges.join(ids.withColumnRenamed("id", "source"), ["sid", "source"], "left_semi").union(edges.join(ids.withColumnRenamed("id", "target"), ["sid", "target"], "left_semi"))
    return hit.distinct()


def compare_structure(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Q3 by structure of (sid, key, ss) against DSSP's letters."""
    ref = reference.select(F.col("sid").alias("r_sid"), *(F.col(c).alias(f"r_{c}") for c in residues.KEY), scalars.reduce_dssp(F.col("ss")).alias("reference"))
    joined = residues.key_join(predicted.withColumn("predicted", scalars.reduce_engine(F.col("ss"))), ref)
    return joined.groupBy("sid").agg(q3("predicted", "reference").alias("q3"), F.count("*").alias("n_residues"))


def compare_surface(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    ref = reference.select(F.col("sid").alias("r_sid"), *(F.col(c).alias(f"r_{c}") for c in residues.KEY), F.col("sasa").alias("reference"))
    joined = residues.key_join(predicted.withColumn("predicted", F.col("sasa")), ref)
    return joined.groupBy("sid").agg(*(c.alias(n) for n, c in error_stats("predicted", "reference").items()), F.count("*").alias("n_residues"))


def compare_contacts(predicted: DataFrame, reference: DataFrame, scope: DataFrame, ligands: DataFrame) -> DataFrame:
    """Agreement of the kinds that each reference file scores, also those in which nothing was found.

    ``scope``: sid, kinds, ligand_scoped; where it is ligand-scoped only
    predicted edges that touch a ligand residue count.
    """
    kinds = scope.select("sid", F.explode("kinds").alias("kind"), F.coalesce("ligand_scoped", F.lit(False)).alias("ligand_scoped")).distinct()
    asked = predicted.select(*_EDGE).join(kinds, ["sid", "kind"])
    counted = asked.where("not ligand_scoped").unionByName(near_ligands(asked.where("ligand_scoped"), ligands))
    found = set_agreement(counted, reference.join(kinds, ["sid", "kind"], "left_semi")).select("sid", "kind", "n_predicted", "n_reference", "n_common")
    return scored(kinds.select("sid", "kind").join(found, ["sid", "kind"], "left").fillna(0))


def predict(structures: dict[str, DataFrame], scale: float = 1.0) -> dict[str, DataFrame]:
    """What is compared of all structures (as ``read_structures`` gives them): ss, bonds, surface, contacts, ligands."""
    from strandex.operators import components, interactions, network, roles, sasa

    atoms = structures["atoms"]
    ss = atoms.groupBy("sid", *residues.KEY).agg(F.min_by("ss", "atom_idx").alias("ss"))
    backbone = structures["bonds"].select("sid", F.lit("backbone").alias("kind"), F.lit(0.0).alias("distance"), F.array("donor_idx").alias("atoms_a"), F.array("acceptor_idx").alias("atoms_b"))
    own = components.perceive(structures["comp_atoms"], structures["comp_bonds"]) if "comp_atoms" in structures else None
    return {
        "ss": ss, "bonds": network.edges(backbone, atoms).select(*_EDGE), "surface": sasa.residue_areas(atoms, scale),
        "contacts": residue_pairs(interactions.detect(atoms, scale, components=own), atoms), "ligands": roles.ligand_residues(atoms),
    }


def compare(predicted: dict[str, DataFrame], references: dict[str, DataFrame | None]) -> tuple[DataFrame, DataFrame | None]:
    """A row for each structure with a reference (q3, hbond_f1, mae and how many residues), and the agreement of contacts.

    ``references``: ss, bonds and bond_scope, surface, contacts and scope; those
    that are missing are left out.
    """
    parts = []
    if references.get("ss") is not None:
        parts.append(compare_structure(predicted["ss"], references["ss"]))
    if references.get("bonds") is not None:
        agreement = compare_contacts(predicted["bonds"], references["bonds"], references["bond_scope"], predicted["ligands"])
        parts.append(agreement.select("sid", F.col("f1").alias("hbond_f1")))
    if references.get("surface") is not None:
        parts.append(compare_surface(predicted["surface"], references["surface"]).withColumnRenamed("n_residues", "n_surface"))
    entries = None
    for part in parts:
        entries = part if entries is None else entries.join(part, "sid", "full")
    if entries is None:
        entries = predicted["ss"].select("sid").limit(0)
    kinds = {"n_residues": "long", "q3": "double", "hbond_f1": "double", "mae": "double", "median_error": "double", "pearson": "double", "n_surface": "long"}
    entries = entries.select("sid", *(F.col(c) if c in entries.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    if references.get("contacts") is None:
        return entries, None
    return entries, compare_contacts(predicted["contacts"], references["contacts"], references["scope"], predicted["ligands"])


def summary(agreement: DataFrame, by: str = "kind") -> DataFrame:
    """Macro means (each structure weighs the same), micro scores (each edge does), totals, and how many entries were vacuous."""
    g = agreement.groupBy(by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.sum(c).alias(c) for c in ("n_predicted", "n_reference", "n_common")), F.count("*").alias("n_entries"), F.sum(F.col("vacuous").cast("int")).alias("n_vacuous"))
    micro = scored(g)
    return micro.select(*g.columns, *(F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")))


def gate(observed: dict[str, float | None], limits: dict[str, float]) -> list[str]:
    """What falls short: limits named min_* are lower, max_* upper bounds; a value that is missing fails."""
    out = []
    for name, limit in limits.items():
        value = observed.get(name[4:])
        if value is None or (value < limit if name.startswith("min_") else value > limit):
            out.append(f"{name[4:]} is {value}, the limit is {limit}")
    return out
