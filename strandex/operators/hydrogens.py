"""Donors and where their hydrogens are: fixed places, or a circle that turns toward the acceptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import geometry as G
from strandex.operators import residues

_EMPTY = "array<struct<x:double,y:double,z:double>>"
_COLUMNS = ("sid", "atom_idx", *residues.KEY, "x", "y", "z", "fixed", "antecedent", "count")


def donors(atoms: DataFrame, scale: float = 1.0, graph: DataFrame | None = None, comp_donors: DataFrame | None = None) -> DataFrame:
    """sid, atom_idx, key, x, y, z; ``fixed`` (positions of fixed hydrogens) or ``antecedent`` and ``count`` of a rotor.

    ``comp_donors`` (sid, comp_id, atom_name, class, count, first, second): the
    donors of other components: 'rotor', 'planar', 'straddling' or 'outward'
    with the names of the neighbour(s) that orient them.
    """
    runs = residues.runs(atoms).withColumn("p", G.at(scale=scale))
    place = runs.groupBy("sid", "run", "name").agg(F.sort_array(F.collect_list(F.struct("atom_idx", "altloc", "p"))).alias("copies"))
    near = lambda name, alias: place.select("sid", "run", F.col("name").alias(name), F.col("copies").alias(alias))

    def copy(alias: str) -> Column:
        """Where the neighbour is in the donor's own conformer, else in none, else in any: the first atom of each."""
        own = F.filter(alias, lambda c: c["altloc"].eqNullSafe(F.col("altloc")))
        shared = F.filter(alias, lambda c: c["altloc"].isNull())
        return F.coalesce(*(F.get(x, F.lit(0))["p"] for x in (own, shared, F.col(alias))))

    spark = atoms.sparkSession
    bonded: dict[tuple[str, str], list[str]] = {}
    for resn, a, b in C.side_chain_bonds():
        bonded.setdefault((resn, a), []).append(b)
        bonded.setdefault((resn, b), []).append(a)
    rows = []
    for (resn, name), (kind, count) in C.DONORS.items():
        first = bonded[resn, name][0]
        second = bonded[resn, name][1] if kind == "bisector" else next(x for x in bonded[resn, first] if x != name)
        rows.append((resn, name, kind, count, first, second))
    table = spark.createDataFrame(rows, "resn string, name string, class string, count int, first string, second string")
    placed = runs.join(F.broadcast(table), ["resn", "name"])  # a fixed table
    columns = [*runs.columns, "class", "count", "first", "second"]
    placed = placed.select(*columns)
    if comp_donors is not None:
        own = comp_donors.select("sid", F.col("comp_id").alias("resn"), F.col("atom_name").alias("name"), "class", "count", "first", "second").where(~F.col("resn").isin(*C.AMINO, *C.WATER))
        found = runs.join(own, ["sid", "resn", "name"])
        if graph is not None:  # every bond beyond the definition takes a hydrogen
            inner = runs.select("sid", F.col("atom_idx").alias("b_idx"), F.col("run").alias("b_run"))
            extra = graph.join(runs.select("sid", F.col("atom_idx").alias("a_idx"), "run"), ["sid", "a_idx"]).join(inner, ["sid", "b_idx"]).where("run <> b_run").groupBy("sid", F.col("a_idx").alias("atom_idx")).agg(F.count("*").alias("extra"))
            found = found.join(extra, ["sid", "atom_idx"], "left").withColumn("count", F.col("count") - F.coalesce("extra", F.lit(0)).cast("int")).where("count > 0")
        placed = placed.unionByName(found.select(*columns))
    placed = placed.join(near("first", "q1"), ["sid", "run", "first"]).join(near("second", "q2"), ["sid", "run", "second"], "left").withColumns({"q1": copy("q1"), "q2": copy("q2")})
    fixed = (
        F.when(F.col("class") == "planar", G.planar_pair(F.col("p"), F.col("q1"), F.col("q2")))
        .when(F.col("class") == "straddling", G.straddling_pair(F.col("p"), F.col("q1"), F.col("q2")))
        .when((F.col("class") == "bisector") & F.col("q2").isNotNull(), F.array(G.outward(F.col("p"), F.array("q1", "q2"))))
        .when(F.col("class") == "outward", F.array(G.outward(F.col("p"), F.filter(F.array("q1", "q2"), lambda q: q.isNotNull()))))
    )
    side = placed.select(*(c for c in _COLUMNS if c not in ("fixed", "antecedent", "count")), fixed.cast(_EMPTY).alias("fixed"), F.when(F.col("class") == "rotor", F.col("q1")).alias("antecedent"), "count").where("(fixed is not null and fixed[0].x is not null) or antecedent is not null")
    return side.unionByName(amides(runs))


def amides(runs: DataFrame) -> DataFrame:
    """Backbone nitrogens: one hydrogen opposite the last carbonyl of the chain, or the three of a chain's first residue."""
    pick = lambda name: F.max_by("p", F.when(F.col("name") == name, F.col("atom_idx")))
    table = runs.groupBy("sid", "run").agg(F.first("chain").alias("r_chain"), pick("C").alias("c"), pick("O").alias("o"), pick("CA").alias("ca"))
    w = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carbonyl = F.when(F.col("c").isNotNull(), F.struct(F.col("r_chain").alias("chain"), "c", "o"))
    table = table.withColumn("before", F.last(carbonyl, ignorenulls=True).over(w)).select("sid", "run", "before", "ca")
    n = runs.where((F.col("name") == "N") & F.col("resn").isin(*[r for r in C.AMINO if r != "PRO"])).join(table, ["sid", "run"])
    inside = F.coalesce(F.col("before.chain") == F.col("chain"), F.lit(False))
    near = G.length(G.sub(F.col("before.c"), F.col("p"))) <= C.PEPTIDE
    h = G.add(F.col("p"), G.times(G.unit(G.sub(F.col("before.c"), F.col("before.o"))), C.BOND_H))
    fixed = F.when(inside & near & F.col("before.o").isNotNull(), F.array(h))
    out = n.select("sid", "atom_idx", *residues.KEY, "x", "y", "z", fixed.cast(_EMPTY).alias("fixed"), F.when(~inside, F.col("ca")).alias("antecedent"), F.when(inside, 1).otherwise(3).alias("count"))
    return out.where("(fixed is not null and fixed[0].x is not null) or antecedent is not null")


def positions_toward(p: str, target: Column, scale: float = 1.0) -> Column:
    """The hydrogens of the donor in columns <p>.., a rotor's turned toward the target."""
    return F.coalesce(F.col(f"{p}fixed"), F.array_repeat(G.rotor_toward(G.at(p, scale), F.col(f"{p}antecedent"), target), F.col(f"{p}count")))


def angles_toward(p: str, target: Column, scale: float = 1.0) -> Column:
    """The angle at each hydrogen between donor and target."""
    d = G.at(p, scale)
    return F.transform(positions_toward(p, target, scale), lambda h: G.angle_at(h, d, target))


def best_toward(p: str, target: Column, scale: float = 1.0) -> Column:
    """angle and place p of the hydrogen that points most nearly at the target."""
    d = G.at(p, scale)
    return F.array_max(F.transform(positions_toward(p, target, scale), lambda h: F.struct(G.angle_at(h, d, target).alias("angle"), h.alias("p"))))
