"""What the structure queries deal out: the atoms once by structure, and no copies of them for neighbour cells."""

import re

import pytest

from strandex.queries import QUERIES

SF = "/root/testdata/sf0.001"


def distinct_shuffles(df) -> int:
    """Shuffles with what is below them; equal ones count once."""
    found, lines = set(), re.sub(r"#\d+L?|\[plan_id=\d+\]", "", df._jdf.queryExecution().executedPlan().toString()).splitlines()
    depth = [len(re.match(r"[\s:+\-*()\d]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if "Exchange " in x and "Broadcast" not in x:
            j = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.add("\n".join(y.lstrip(" :+-") for y in lines[i:j]))
    return len(found)


#: Shuffles of each query: the atoms, then what is found, which meets the atoms where they are.
MOST = {"bond_graph": 1, "sasa_residue": 2, "halogen_bond": 1, "hydrophobic": 1, "rin_edges": 2, "interactions_all": 2, "rin_nodes": 3, "interactions_dedup": 2, "metrics_prf1": 5, "rin_betweenness": 3, "rin_bfs_distance": 5, "edge_intensity": 3, "rin_components": 3, "rin_cut_residues": 3, "rin_kind_rollup": 3, "rin_top_components": 5}


@pytest.mark.parametrize("name", sorted(MOST))
def test_atoms_are_dealt_out_once(spark, name):
    df = QUERIES[name](spark, SF)
    assert distinct_shuffles(df) <= MOST[name]
    assert "Generate" not in df._jdf.queryExecution().toString()  # no copies into 27 cells


def test_kernel_contacts_are_those_of_the_operators(spark):
    """The kernel of all kinds against the operators that components go through."""
    from strandex import constants as C
    from strandex.operators import bonds, hydrogens, interactions, roles
    from strandex.sources import pseudo

    a, s = pseudo.atoms(spark, "/root/testdata/sf0.001"), pseudo.SCALE
    graph, donors, accept, groups, rings = bonds.graph(a, s), hydrogens.donors(a, s), roles.acceptors(a), interactions.charged_groups(a, s), interactions.rings(a, s)
    parts = [
        interactions.hydrogen_bonds(donors, accept, s), interactions.salt_bridges(a, s, groups), interactions.hydrophobic(a, graph, s), interactions.pi_stacking(rings, s), interactions.pi_cation(rings, groups, s),
        interactions.halogen_bonds(a, graph, s), interactions.water_bridges(a, donors, accept, s), interactions.metal_coordination(a, s), interactions.disulfides(a, s),
    ]
    rows = lambda df: sorted((r.sid, r.kind, r.atoms_a, r.atoms_b, round(r.distance, 6), -1 if r.angle is None else round(r.angle, 6), r.bridge or -1) for r in df.collect())
    want = sorted(x for p in parts for x in rows(p))
    assert want and rows(interactions.detect(a, s)) == want
    assert {x[1] for x in want} <= set(C.KINDS)


def test_kernel_rings_and_cations(spark):
    """Two stacked rings of phenylalanine, a tryptophan and a lysine over one of them: kernel and operators."""
    import math

    from strandex.operators import interactions
    from tests.structure.test_kernels import ATOMS, atom

    names, rows = ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), []
    for k, z in ((1, 0.0), (2, 3.8), (4, 40.0)):
        rows += [atom(len(rows) + i, n, "PHE", k, 1.4 * math.cos(i * math.pi / 3), 1.4 * math.sin(i * math.pi / 3), z) for i, n in enumerate(names)]
    rows += [atom(len(rows), "NZ", "LYS", 3, 0.2, 0.1, -4.0)]
    a = spark.createDataFrame(rows, ATOMS)
    rings, groups = interactions.rings(a), interactions.charged_groups(a)
    flat = lambda df: sorted((r.kind, r.atoms_a, r.atoms_b, round(r.distance, 6), None if r.angle is None else round(r.angle, 6)) for r in df.collect())
    want = flat(interactions.pi_stacking(rings)) + flat(interactions.pi_cation(rings, groups))
    assert {x[0] for x in want} == {"pi-stacking", "pi-cation"}
    assert flat(interactions.detect(a, kinds=("pi-stacking", "pi-cation"))) == sorted(want)


#: Queries that read the edges once: the atoms, the edges or their sums, and for the largest components two more of few rows.
ONCE = {"rin_components": 2, "rin_cut_residues": 2, "rin_kind_rollup": 2, "rin_top_components": 4}


@pytest.mark.parametrize("name", sorted(ONCE))
def test_contacts_are_not_shuffled(spark, name):
    df = QUERIES[name](spark, SF)
    assert distinct_shuffles(df) <= ONCE[name]
    assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()  # the atoms aren't read again


@pytest.mark.parametrize("kinds", [None, ("salt-bridge",), ("disulfide", "pi-stacking")])
def test_detected_edges_are_those_of_the_contacts(spark, kinds):
    from strandex import constants as C
    from strandex.operators import interactions, network
    from strandex.sources import pseudo

    a, k = pseudo.atoms(spark, SF), kinds or C.KINDS
    lone = a.where("atom_idx = 1 and sid = 0").selectExpr("-1 as sid", *(c for c in a.columns if c != "sid"))  # a structure without a contact
    a = a.unionByName(lone)
    want, got = network.edges(interactions.detect(a, pseudo.SCALE, k), a), network.detected_edges(a, pseudo.SCALE, k)
    assert got.schema == want.schema
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(want) and rows(got) == rows(want)
