"""Secondary structure from backbone hydrogen bonds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import geometry as G
from strandex.operators import residues, spatial


def backbone(atoms: DataFrame, scale: float = 1.0, peptide: float = C.PEPTIDE) -> DataFrame:
    """One row for each residue run: positions n, c, o and amide hydrogen h (ångström, null if missing)."""
    a = residues.runs(atoms).withColumn("p", G.at(scale=scale))
    pick = lambda name, what: F.max_by(what, F.when(F.col("name") == name, F.col("atom_idx")))  # noqa: E731  the last of repeated names
    table = a.groupBy("sid", "run").agg(
        F.min_by("resn", "atom_idx").alias("resn"), *(F.first(k, ignorenulls=False).alias(k) for k in residues.KEY),
        pick("N", F.col("p")).alias("n"), pick("C", F.col("p")).alias("c"), pick("O", F.col("p")).alias("o"), pick("N", F.col("atom_idx")).alias("n_idx"), pick("O", F.col("atom_idx")).alias("o_idx"),
    )
    w = Window.partitionBy("sid").orderBy("run")
    before = F.lag(F.struct("chain", "c", "o")).over(w)
    table = table.withColumn("before", before)
    fits = (F.col("resn") != "PRO") & (F.col("before.chain") == F.col("chain")) & (G.length(G.sub(F.col("before.c"), F.col("n"))) <= peptide)
    h = G.add(F.col("n"), G.unit(G.sub(F.col("before.c"), F.col("before.o"))))
    return table.withColumn("h", F.when(fits & F.col("n").isNotNull() & F.col("before.c").isNotNull() & F.col("before.o").isNotNull(), h)).drop("before")


def bonds(table: DataFrame, most: int = 2) -> DataFrame:
    """sid, acceptor, donor (runs), acceptor_idx, donor_idx, energy: the ``most`` lowest of each donor."""
    acceptors = table.where("c is not null and o is not null").select("sid", "run", "chain", "c", "o", F.col("o_idx").alias("idx"), *(F.col(f"o.{k}").alias(k) for k in "xyz"))
    donors = table.where("n is not null and h is not null and h.x is not null").select("sid", "run", "chain", "n", "h", F.col("n_idx").alias("idx"), *(F.col(f"n.{k}").alias(k) for k in "xyz"))
    pairs = spatial.radius_join(acceptors, donors, C.DSSP_REACH).where("a_run <> b_run and not (a_chain = b_chain and abs(a_run - b_run) = 1)")
    pairs = pairs.withColumn("energy", G.bond_energy(F.col("a_o"), F.col("a_c"), F.col("b_n"), F.col("b_h"))).where(F.col("energy") < C.DSSP_LIMIT)
    w = Window.partitionBy("a_sid", "b_run").orderBy("energy", "a_run")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(F.col("a_sid").alias("sid"), F.col("a_run").alias("acceptor"), F.col("b_run").alias("donor"), F.col("a_idx").alias("acceptor_idx"), F.col("b_idx").alias("donor_idx"), "energy")


def ordered(bonds_: DataFrame) -> DataFrame:
    """Bonds by structure, donor and acceptor."""
    return bonds_.orderBy("sid", "donor", "acceptor")


def structure(table: DataFrame, bonds_: DataFrame) -> DataFrame:
    """sid, run, ss: helix over sheet over 3-10 and pi helix over turn over coil, as a set of joins."""
    chain = table.select("sid", "run", "chain")
    b = bonds_.select("sid", F.col("acceptor").alias("a"), F.col("donor").alias("d")).distinct()
    ca = chain.select("sid", F.col("run").alias("a"), F.col("chain").alias("a_chain"))
    cd = chain.select("sid", F.col("run").alias("d"), F.col("chain").alias("d_chain"))
    b = b.join(ca, ["sid", "a"]).join(cd, ["sid", "d"])
    turns = b.where("a_chain = d_chain and d - a in (3, 4, 5)").select("sid", F.col("a").alias("i"), (F.col("d") - F.col("a")).alias("step"))
    pairs = turns.join(turns.select("sid", (F.col("i") + 1).alias("i"), "step"), ["sid", "i", "step"])

    def span(df: DataFrame, lo: int, hi, code: str, rank: int) -> DataFrame:
        return df.select("sid", F.explode(F.sequence(F.col("i") + lo, F.col("i") + hi)).alias("run"), F.lit(rank).alias("rank"), F.lit(code).alias("code"))

    marks = [span(pairs.where("step = 4"), 0, F.lit(3), "H", 0), span(pairs.where("step = 3"), 0, F.lit(2), "H", 2), span(pairs.where("step = 5"), 0, F.lit(4), "H", 2), span(turns, 1, F.col("step") - 1, "T", 3)]
    one = b.select("sid", "a", "d")
    shifted = lambda a, d, x, y: one.select("sid", (F.col("a") + a).alias(x), (F.col("d") + d).alias(y))
    # (i, j) of each pattern; a neighbour must be of its residue's chain
    parallel = shifted(1, 0, "i", "j").join(one.select("sid", F.col("a").alias("j"), (F.col("d") - 1).alias("i")), ["sid", "i", "j"]).select("sid", "i", "j", F.lit(1).alias("ni"), F.lit(0).alias("nj"))
    anti = one.select("sid", F.col("a").alias("i"), F.col("d").alias("j")).join(one.select("sid", F.col("d").alias("i"), F.col("a").alias("j")), ["sid", "i", "j"]).select("sid", "i", "j", F.lit(0).alias("ni"), F.lit(0).alias("nj"))
    outer = shifted(1, -1, "i", "j").join(one.select("sid", (F.col("a") + 1).alias("j"), (F.col("d") - 1).alias("i")), ["sid", "i", "j"]).select("sid", "i", "j", F.lit(1).alias("ni"), F.lit(1).alias("nj"))
    bridges = reduce(DataFrame.unionByName, [parallel, anti, outer]).where("i <> j")
    w = Window.partitionBy("sid").orderBy("run")
    inner = chain.withColumn("inside", (F.lag("chain").over(w) == F.col("chain")) & (F.lead("chain").over(w) == F.col("chain")))
    side = lambda x: inner.select("sid", F.col("run").alias(x), F.col("chain").alias(f"{x}_chain"), F.coalesce("inside", F.lit(False)).alias(f"{x}_inside"))
    bridges = bridges.join(side("i"), ["sid", "i"]).join(side("j"), ["sid", "j"]).where("(ni = 0 or i_inside) and (nj = 0 or j_inside) and not (i_chain = j_chain and abs(i - j) < 3)")
    sheet = bridges.select("sid", F.explode(F.array("i", "j")).alias("run"), F.lit(1).alias("rank"), F.lit("E").alias("code"))
    best = reduce(DataFrame.unionByName, [*marks, sheet]).groupBy("sid", "run").agg(F.min_by("code", "rank").alias("code"))
    return chain.join(best, ["sid", "run"], "left").select("sid", "run", F.coalesce("code", F.lit("C")).alias("ss"))


def assign(atoms: DataFrame, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The atoms with ``ss`` (by residue key; a key that comes back takes its last run's), and the bonds."""
    table = backbone(atoms, scale)
    found = bonds(table)
    by_key = table.join(structure(table, found), ["sid", "run"]).groupBy("sid", *residues.KEY).agg(F.max_by("ss", "run").alias("ss"))
    by_key = by_key.select(F.col("sid").alias("r_sid"), *(F.col(c).alias(f"r_{c}") for c in residues.KEY), "ss")
    return residues.key_join(atoms, by_key, "left").select(*atoms.columns, F.coalesce("ss", F.lit("C")).alias("ss")), found
