"""The nine kinds of typed contacts.

Each is a role filter, a radius join on cells, a geometric rest, and sometimes
a reduction.  Results share the columns COLUMNS; ``atoms_a`` and ``atoms_b`` are
arrays of atom_idx, the first of which stands for its side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import geometry as G
from strandex.functions import scalars
from strandex.operators import bonds, kernels, residues, roles, spatial

COLUMNS = ("sid", "kind", "atoms_a", "atoms_b", "distance", "angle", "bridge")


def _atoms(df: DataFrame) -> DataFrame:
    return df.select("sid", "atom_idx", "chain", "resi", "icode", "resn", "name", "x", "y", "z")


def _out(pairs: DataFrame, kind: str, a: Column | None = None, b: Column | None = None, distance: Column | None = None, angle: Column | None = None, bridge: Column | None = None, scale: float = 1.0) -> DataFrame:
    return pairs.select(
        F.col("a_sid").alias("sid"), F.lit(kind).alias("kind"),
        (F.array(F.col("a_atom_idx")) if a is None else a).cast("array<int>").alias("atoms_a"), (F.array(F.col("b_atom_idx")) if b is None else b).cast("array<int>").alias("atoms_b"),
        (spatial.angstrom(scale) if distance is None else distance).alias("distance"), (F.lit(None) if angle is None else angle).cast("double").alias("angle"), (F.lit(None) if bridge is None else bridge).cast("int").alias("bridge"),
    )


def disulfides(atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    s = _atoms(atoms.where(roles.cysteine_sulfur()))
    pairs = spatial.radius_join(s, s, C.DISULFIDE, scale, where=F.col("a_atom_idx") < F.col("b_atom_idx"))
    return _out(pairs.where(F.col("d2") > (C.LEAST * scale) ** 2), "disulfide", scale=scale)


def metal_coordination(atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    pairs = spatial.radius_join(_atoms(atoms.where(roles.metal_donor())), _atoms(atoms.where(roles.metal())), C.METAL, scale)
    pairs = pairs.where(spatial.gate(C.LEAST, C.METAL, scale))
    return _out(pairs, "metal-coordination", a=F.array("b_atom_idx"), b=F.array("a_atom_idx"), scale=scale)


def charged_groups(atoms: DataFrame, scale: float = 1.0, sites: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """sid, chain, resi, icode, sign, atoms (ascending), and centroid x, y, z of the atoms that are there.

    Standard residues by the fixed table; others by ``sites`` (sid, comp_id,
    site, sign, atom_name, centre), except sites whose centre has a bond into
    another residue.
    """
    spark = atoms.sparkSession
    table = spark.createDataFrame([(r, 0, s, n, None) for r, (s, names) in C.CHARGED.items() for n in names], "resn string, site int, sign int, name string, centre string")
    runs = residues.runs(atoms)
    parts = runs.join(F.broadcast(table), ["resn", "name"]).select("sid", "run", "site", "sign", "atom_idx", *residues.KEY, "x", "y", "z")  # ten fixed rows
    if sites is not None:
        own = sites.select("sid", F.col("comp_id").alias("resn"), "site", "sign", F.col("atom_name").alias("name"), "centre").where(~F.col("resn").isin(*C.AMINO, *C.WATER))
        found = runs.join(own, ["sid", "resn", "name"])
        if graph is not None:
            place = runs.select("sid", "atom_idx", "run", "name")
            beyond = graph.join(place.withColumnRenamed("atom_idx", "a_idx"), ["sid", "a_idx"]).join(place.select("sid", F.col("atom_idx").alias("b_idx"), F.col("run").alias("b_run")), ["sid", "b_idx"]).where("run <> b_run").select("sid", "run", F.col("name").alias("centre")).distinct()
            found = found.join(beyond, ["sid", "run", "centre"], "left_anti")
        parts = parts.unionByName(found.select(*parts.columns))
    return parts.groupBy("sid", "run", "site", "sign").agg(*(F.first(k).alias(k) for k in residues.KEY), F.sort_array(F.collect_list("atom_idx")).alias("atoms"), *((F.sum(c) / F.count("*")).alias(c) for c in "xyz"))


def salt_bridges(atoms: DataFrame, scale: float = 1.0, groups: DataFrame | None = None) -> DataFrame:
    groups = charged_groups(atoms, scale) if groups is None else groups
    pairs = spatial.radius_join(groups.where("sign > 0"), groups.where("sign < 0"), C.SALT, scale)
    pairs = pairs.where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.SALT, scale))
    return _out(pairs, "salt-bridge", F.col("a_atoms"), F.col("b_atoms"), scale=scale)


def rings(atoms: DataFrame, scale: float = 1.0, members: dict | None = None, comp_rings: DataFrame | None = None) -> DataFrame:
    """sid, ring (number in the structure's run), chain, resi, icode, atoms in ring order, centre x, y, z and unit normal.

    A ring with a missing atom is none; of a repeated name the first atom counts,
    and the residue is what its first atom says.  ``members``: residue to tuples of names
    (by default the standard ones); ``comp_rings``: sid, comp_id, ring, ord, size, atom_name.
    """
    spark = atoms.sparkSession
    rows = [(r, k, i, len(names), n) for r, found in (C.RINGS if members is None else members).items() for k, names in enumerate(found) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "resn string, ring int, ord int, size int, name string")
    runs = residues.runs(atoms).withColumn("resn", F.first("resn").over(Window.partitionBy("sid", "run").orderBy("atom_idx")))
    parts = runs.join(F.broadcast(table), ["resn", "name"]).select("sid", "run", "ring", "ord", "size", "atom_idx", *residues.KEY, "x", "y", "z")  # a fixed table
    if comp_rings is not None:
        own = comp_rings.select("sid", F.col("comp_id").alias("resn"), "ring", "ord", "size", F.col("atom_name").alias("name")).where(~F.col("resn").isin(*C.AMINO))
        parts = parts.unionByName(runs.join(own, ["sid", "resn", "name"]).select(*parts.columns))
    one = parts.groupBy("sid", "run", "ring", "size", "ord").agg(F.min_by(F.struct("atom_idx", *residues.KEY, "x", "y", "z"), "atom_idx").alias("m"))
    whole = one.groupBy("sid", "run", "ring", "size").agg(F.sort_array(F.collect_list(F.struct("ord", "m"))).alias("members")).where(F.size("members") == F.col("size"))
    points = F.transform("members", lambda r: G.vec(r["m"]["x"] / scale, r["m"]["y"] / scale, r["m"]["z"] / scale))
    total = lambda c: F.aggregate("members", F.lit(0.0), lambda s, r: s + r["m"][c])
    first = F.col("members")[0]["m"]
    return whole.select("sid", "run", "ring", *(first[k].alias(k) for k in residues.KEY), F.transform("members", lambda r: r["m"]["atom_idx"]).alias("atoms"), *((total(c) / F.col("size")).alias(c) for c in "xyz"), G.newell_normal(points).alias("normal")).where("normal is not null and normal.x is not null")


def _offset(point: str, ring: str, scale: float) -> Column:
    return G.planar_offset(G.at(point, scale), G.at(ring, scale), F.col(f"{ring}normal"))


def pi_stacking(rings_: DataFrame, scale: float = 1.0) -> DataFrame:
    pairs = spatial.radius_join(rings_, rings_, C.PI_STACK, scale, where=F.struct("a_run", "a_ring") < F.struct("b_run", "b_ring"))
    pairs = pairs.where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.PI_STACK, scale))
    pairs = pairs.withColumns({"offset": F.least(_offset("b_", "a_", scale), _offset("a_", "b_", scale)), "angle": G.plane_angle(F.col("a_normal"), F.col("b_normal"))})
    pairs = pairs.where((F.col("offset") < C.OFFSET) & ((F.col("angle") < C.PLANE_ANGLE) | (F.col("angle") > 90 - C.PLANE_ANGLE)))
    return _out(pairs, "pi-stacking", F.col("a_atoms"), F.col("b_atoms"), angle=F.col("angle"), scale=scale)


def pi_cation(rings_: DataFrame, groups: DataFrame, scale: float = 1.0) -> DataFrame:
    """Side a is the ring."""
    pairs = spatial.radius_join(rings_, groups.where("sign > 0"), C.PI_CATION, scale)
    pairs = pairs.where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.PI_CATION, scale)).where(_offset("b_", "a_", scale) < C.OFFSET)
    return _out(pairs, "pi-cation", F.col("a_atoms"), F.col("b_atoms"), scale=scale)


def closest(contacts: DataFrame) -> DataFrame:
    """For each atom and residue on the other side the shortest contact, then the same the other way round."""
    row = F.struct(*contacts.columns)
    least = F.struct("d2", "a_atom_idx", "b_atom_idx")
    once = contacts.groupBy("a_sid", "a_atom_idx", F.struct("b_chain", "b_resi", "b_icode").alias("k")).agg(F.min_by(row, least).alias("r")).select("r.*")
    return once.groupBy("a_sid", "b_atom_idx", F.struct("a_chain", "a_resi", "a_icode").alias("k")).agg(F.min_by(F.struct(*once.columns), least).alias("r")).select("r.*")


def hydrophobic(atoms: DataFrame, graph: DataFrame, scale: float = 1.0) -> DataFrame:
    c = bonds.apolar_carbons(atoms, graph).select("sid", "atom_idx", *residues.KEY, "x", "y", "z")
    pairs = spatial.radius_join(c, c, C.HYDROPHOBIC, scale, where=F.col("a_atom_idx") < F.col("b_atom_idx"))
    pairs = pairs.where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.HYDROPHOBIC, scale))
    return _out(closest(pairs), "hydrophobic", scale=scale)


def halogen_bonds(atoms: DataFrame, graph: DataFrame, scale: float = 1.0, elements: tuple[str, ...] = C.HALOGENS) -> DataFrame:
    """A halogen on a single carbon, an acceptor on a single antecedent, and an angle at either."""
    def with_sole(df, which):
        return _atoms(df).join(bonds.sole_neighbour(atoms, graph, which).select("sid", "atom_idx", *(F.col(f"b_{c}").alias(f"n_{c}") for c in "xyz")), ["sid", "atom_idx"])

    element = F.upper("element")
    pairs = spatial.radius_join(with_sole(atoms.where(element.isin(*C.HALOGEN_ACCEPTORS)), C.ANTECEDENTS), with_sole(atoms.where(element.isin(*elements)), ("C",)), C.HALOGEN, scale)
    pairs = pairs.where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.HALOGEN, scale))
    acceptor, halogen = G.at("a_", scale), G.at("b_", scale)
    pairs = pairs.withColumns({"at_acceptor": G.angle_at(acceptor, G.at("a_n_", scale), halogen), "at_halogen": G.angle_at(halogen, acceptor, G.at("b_n_", scale))})
    near = lambda c, v: G.strictly_within(F.col(c), v - C.HALOGEN_SLACK, v + C.HALOGEN_SLACK)
    pairs = pairs.where(near("at_acceptor", C.HALOGEN_ACCEPTOR) & near("at_halogen", C.HALOGEN_DONOR))
    return _out(pairs, "halogen-bond", F.array("b_atom_idx"), F.array("a_atom_idx"), angle=F.col("at_halogen"), scale=scale)


def assign(reachable: DataFrame) -> DataFrame:
    """Each donor's hydrogens given to acceptors, the straightest first: no hydrogen and no acceptor twice.

    ``reachable``: a_sid, a_atom_idx (donor), b_atom_idx, angles (of each
    hydrogen), and what else is to be kept.  One donor's candidates are few
    (what fits into a sphere), so they are folded as one sorted array.
    """
    row = F.struct(*[c for c in reachable.columns if c not in ("angles",)])
    # sorted by angle down, then acceptor and hydrogen up
    flat = reachable.select("a_sid", "a_atom_idx", row.alias("row"), F.posexplode("angles").alias("hydrogen", "angle")).where(F.col("angle") > C.HBOND_ANGLE)
    ordered = flat.groupBy("a_sid", "a_atom_idx").agg(F.sort_array(F.collect_list(F.struct((-F.col("angle")).alias("rank"), F.col("row.b_atom_idx").alias("b"), F.col("hydrogen").alias("h"), F.col("row").alias("row")))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("spent"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, r: F.when(F.array_contains(s["spent"], r["h"]) | F.array_contains(s["taken"], r["b"]), s).otherwise(F.struct(F.array_append(s["spent"], r["h"]).alias("spent"), F.array_append(s["taken"], r["b"]).alias("taken")))
    folded = ordered.withColumn("done", F.aggregate("all", start, step))
    pairs = folded.select("all", F.explode(F.arrays_zip("done.spent", "done.taken")).alias("p"))
    return pairs.select(F.filter("all", lambda r: (r["h"] == F.col("p.spent")) & (r["b"] == F.col("p.taken")))[0].alias("r")).select("r.row.*", (-F.col("r.rank")).alias("angle"))


def hydrogen_bonds(donors: DataFrame, acceptors: DataFrame, scale: float = 1.0) -> DataFrame:
    """``donors``: from hydrogens.donors()."""
    from strandex.operators import hydrogens

    pairs = spatial.radius_join(_atoms(acceptors), donors, C.HBOND, scale).where(~residues.same_residue("a_", "b_") & spatial.gate(C.LEAST, C.HBOND, scale))
    pairs = pairs.withColumn("angles", hydrogens.angles_toward("b_", G.at("a_", scale), scale))
    swapped = pairs.select(F.col("a_sid"), F.col("b_atom_idx").alias("a_atom_idx"), F.col("a_atom_idx").alias("b_atom_idx"), "d2", "angles")
    return _out(assign(swapped), "hydrogen-bond", angle=F.col("angle"), scale=scale)


def water_bridges(atoms: DataFrame, donors: DataFrame, acceptors: DataFrame, scale: float = 1.0) -> DataFrame:
    """Donor to water to acceptor: both legs in the band, joined on the water."""
    from strandex.operators import hydrogens

    lo, hi = C.WATER_LEGS
    waters = atoms.where(roles.water_oxygen()).select("sid", "atom_idx", "x", "y", "z")
    band = F.col("d2") >= F.lit(int(round(lo * scale)) ** 2 if scale != 1 else lo * lo)
    first = spatial.radius_join(donors, waters, hi, scale).where(band)
    water = G.at("b_", scale)
    first = first.withColumn("hydrogen", hydrogens.best_toward("a_", water, scale)).where(F.col("hydrogen.angle") > C.WATER_THETA)
    first = first.select(F.col("a_sid"), F.col("b_atom_idx").alias("w"), "a_atom_idx", "a_chain", "a_resi", "a_icode", F.col("d2").alias("d2_a"), "hydrogen", *(F.col(f"b_{c}").alias(f"w_{c}") for c in "xyz"))
    second = spatial.radius_join(_atoms(acceptors), waters, hi, scale).where(band).select(F.col("a_sid").alias("s_sid"), F.col("b_atom_idx").alias("s_w"), F.col("a_atom_idx").alias("b_atom_idx"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in ("chain", "resi", "icode", "x", "y", "z")), F.col("d2").alias("d2_b"))
    pairs = first.join(second, (F.col("a_sid") == F.col("s_sid")) & (F.col("w") == F.col("s_w"))).where(~residues.same_residue("a_", "b_"))
    pairs = pairs.withColumn("omega", G.angle_at(G.at("w_", scale), G.at("b_", scale), F.col("hydrogen.p"))).where(G.strictly_within(F.col("omega"), *C.WATER_OMEGA))
    return _out(pairs.withColumn("d2", F.greatest("d2_a", "d2_b")), "water-bridge", angle=F.col("omega"), bridge=F.col("w"), scale=scale)


def detect(atoms: DataFrame, scale: float = 1.0, kinds: tuple[str, ...] = C.KINDS, components: dict[str, DataFrame] | None = None, halogens: tuple[str, ...] = C.HALOGENS) -> DataFrame:
    """The union of the kinds asked for; kinds left out cost nothing.

    ``components``: bonds, roles, sites, rings and hydrogens of the non-standard
    components, from operators.components.  Without them a kernel finds all
    kinds of a structure at once, and no atom is shuffled for any of them.
    """
    if components is None:
        return kernels.per_structure(atoms, lambda s: kernels.contacts(s, kinds, halogens), "kind string, atoms_a array<int>, atoms_b array<int>, distance double, angle double, bridge int", scale)
    from strandex.operators import hydrogens

    from functools import cache

    own = components
    shared = lambda make: cache(lambda: make().persist())  # noqa: E731  several kinds read each of these; lost blocks are made again
    graph = shared(lambda: bonds.graph(atoms, scale, own.get("bonds")))
    groups = shared(lambda: charged_groups(atoms, scale, own.get("sites"), graph() if "sites" in own else None))
    rings_ = shared(lambda: rings(atoms, scale, comp_rings=own.get("rings")))
    donors = shared(lambda: hydrogens.donors(atoms, scale, graph() if "hydrogens" in own else None, own.get("hydrogens")))
    accept = shared(lambda: roles.acceptors(atoms, own.get("roles"), graph() if "roles" in own else None))
    makers = {
        "hydrogen-bond": lambda: hydrogen_bonds(donors(), accept(), scale), "salt-bridge": lambda: salt_bridges(atoms, scale, groups()), "hydrophobic": lambda: hydrophobic(atoms, graph(), scale),
        "pi-stacking": lambda: pi_stacking(rings_(), scale), "pi-cation": lambda: pi_cation(rings_(), groups(), scale), "halogen-bond": lambda: halogen_bonds(atoms, graph(), scale, halogens),
        "water-bridge": lambda: water_bridges(atoms, donors(), accept(), scale), "metal-coordination": lambda: metal_coordination(atoms, scale), "disulfide": lambda: disulfides(atoms, scale),
    }
    return reduce(DataFrame.unionByName, [makers[k]() for k in C.KINDS if k in kinds])


def dedup_conformers(found: DataFrame, atoms: DataFrame) -> DataFrame:
    """One of the contacts that name the same atoms (by residue and name) in different conformers: the first by atom_idx."""
    ids = atoms.select("sid", "atom_idx", F.concat_ws("|", "chain", F.col("resi").cast("string"), F.coalesce("icode", F.lit("")), "name").alias("id"))

    def kernel(contacts, table):
        s = kernels.Structure(table)
        code = pc.dictionary_encode(s.column("id")).indices.to_numpy()
        named = dict(zip(s.idx.tolist(), code.tolist(), strict=True))
        best: dict[tuple, tuple] = {}
        rows = zip(*(contacts.column(c).to_pylist() for c in ("kind", "atoms_a", "atoms_b", "bridge")), strict=True)
        for row, (kind, a, b, bridge) in enumerate(rows):
            a_id, b_id = (tuple(sorted(named[x] for x in side if x in named)) for side in (a, b))
            if a_id and b_id:
                key, order = (kind, a_id, b_id, named.get(bridge)), (a, b, -1 if bridge is None else bridge, row)
                if key not in best or order < best[key]:
                    best[key] = order
        kept = contacts.take(pa.array([x[-1] for x in best.values()], pa.int64()))
        return {c: kept.column(c) for c in kept.column_names if c != "sid"}

    columns = ("sid", *(c for c in found.columns if c != "sid"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "sid")
    return kernels.with_atoms(found.select(*columns), ids, kernel, schema, ("sid", "atom_idx", "id")).select(*found.columns)


def touching(found: DataFrame, selected: DataFrame) -> DataFrame:
    """Contacts of which either side has a selected atom (sid, atom_idx)."""
    keyed = found.withColumn("n", F.xxhash64("sid", "kind", "atoms_a", "atoms_b", "bridge"))
    hit = keyed.select("sid", "n", F.explode(F.concat("atoms_a", "atoms_b")).alias("atom_idx")).join(selected.select("sid", "atom_idx"), ["sid", "atom_idx"], "left_semi").select("sid", "n").distinct()
    return keyed.join(hit, ["sid", "n"], "left_semi").drop("n")


def records(found: DataFrame, atoms: DataFrame) -> DataFrame:
    """The thirteen report columns: kind, chain/resi/icode/resn/atoms of both sides, distance (2 places), angle (1 place)."""
    own = ("chain", "resi", "icode", "resn")

    def kernel(contacts, table):
        s = kernels.Structure(table)
        out, whole = {}, np.ones(contacts.num_rows, bool)
        for p in "ab":
            lists = contacts.column(f"atoms_{p}").combine_chunks()
            contact, at = pc.list_parent_indices(lists).to_numpy(), s.places(pc.list_flatten(lists).to_numpy())
            contact, at = contact[at >= 0], at[at >= 0]
            ends = np.searchsorted(contact, np.arange(len(lists) + 1))
            whole &= ends[1:] > ends[:-1]
            first = pa.array(np.append(at, 0)[np.minimum(ends[:-1], len(at))])
            names = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), s.column("name").take(pa.array(at)))
            out |= {f"{p}_{c}": s.column(c).take(first) for c in own} | {f"{p}_atoms": pc.binary_join(names, "+")}
        kept = pa.array(whole)
        return {"kind": contacts.column("kind").filter(kept), **{c: v.filter(kept) for c, v in out.items()}, **{c: contacts.column(c).filter(kept) for c in ("distance", "angle")}}

    kind = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    sides = ", ".join(f"{p}_{c} {kind.get(c, 'string')}" for p in "ab" for c in (*own, "atoms"))
    joined = kernels.with_atoms(found.select("sid", "kind", "atoms_a", "atoms_b", "distance", "angle"), atoms, kernel, f"kind string, {sides}, distance double, angle double", ("sid", "atom_idx", *own, "name"))
    return joined.select("sid", "kind", *(f"{p}_{c}" for p in "ab" for c in (*own, "atoms")), F.round("distance", 2).alias("distance"), F.round("angle", 1).alias("angle"), scalars.kind_order(F.col("kind")).alias("kind_ord"))


def ordered(found: DataFrame) -> DataFrame:
    """Contacts by structure, kind and the atoms of either side."""
    return found.orderBy("sid", scalars.kind_order(F.col("kind")), "atoms_a", "atoms_b", "bridge")


REPORT_ORDER = ("sid", "kind", "a_chain", "a_resi", "a_icode", "b_chain", "b_resi", "b_icode", "a_atoms", "b_atoms")
