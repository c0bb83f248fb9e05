"""Selections, files, chemistry, graphs and surfaces on small inputs."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import geometry as G
from strandex.functions import scalars
from strandex.operators import bonds, components, hydrogens, interactions, network, residues, roles, sasa, validation
from strandex.plans import selection
from strandex.sinks import reports
from strandex.sources import golden, mmcif

ATOMS = "sid string, atom_idx int, name string, element string, resn string, resi int, chain string, icode string, is_hetatm boolean, altloc string, occupancy double, b_factor double, x double, y double, z double"


def atom(i, name, resn, resi, x, y, z, chain="A", element=None, het=False, altloc=None, occ=1.0, icode=None, sid="s"):
    return (sid, i, name, element or name[0], resn, resi, chain, icode, het, altloc, occ, 10.0, float(x), float(y), float(z))


@pytest.fixture
def build(spark):
    return lambda rows: spark.createDataFrame(rows, ATOMS)


@pytest.mark.parametrize("text", ["resi and", "chain", "", "within x of all", "within -1 of all", "resi 5-", "(all", "all all", "ss X", "bfactor 5", "foo", "not", "within inf of all"])
def test_selection_errors(text):
    with pytest.raises(selection.SelectionError):
        selection.parse(text)


def test_selection_trees():
    N = selection.Node
    assert selection.parse("not chain A and water or byres resi 1 5-9") == N("or", (N("and", (N("not", (N("chain", ("A",)),)), N("water"))), N("byres", (N("resi", ((1, 1), (5, 9))),))))
    assert selection.parse("within 4 of water and metal") == N("and", (N("within", (4.0, N("water"))), N("metal")))
    assert selection.parse("NOT (ALL)") == N("not", (N("all"),))
    with pytest.raises(selection.SelectionError, match="deep"):
        selection.parse("not " * 200 + "all")


def test_empty_selection_is_an_error(build):
    a = build([atom(0, "CA", "ALA", 1, 0, 0, 0)])
    with pytest.raises(selection.SelectionError):
        selection.select_some("chain ZZZ", a)
    assert selection.select_some("within 0 of all", a).count() == 1


def test_altlocs_choose_one_label_for_a_residue(build):
    rows = [atom(0, "N", "SER", 1, 0, 0, 0), atom(1, "CA", "SER", 1, 1, 0, 0, altloc="A", occ=0.4), atom(2, "CA", "SER", 1, 2, 0, 0, altloc="B", occ=0.6), atom(3, "OG", "SER", 1, 3, 0, 0, altloc="A", occ=0.9), atom(4, "OG", "SER", 1, 4, 0, 0, altloc="B", occ=0.1), atom(5, "CB", "SER", 1, 5, 0, 0, altloc="A", occ=0.5)]
    got = {r.atom_idx: (r.name, r.altloc) for r in residues.altloc(build(rows)).collect()}
    assert got == {0: ("N", None), 1: ("CA", "B"), 3: ("OG", "B"), 5: ("CB", "A")}
    assert residues.altloc(build(rows), "A").count() == 4


def test_disulfide_gates(build):
    for x, n in ((2.0, 1), (2.5, 1), (2.51, 0), (0.5, 0)):
        a = build([atom(0, "SG", "CYS", 1, 0, 0, 0), atom(1, "SG", "CYS", 9, x, 0, 0)])
        assert interactions.disulfides(a).count() == n


def test_hydrophobic_keeps_the_closest(build):
    rows = [atom(0, "CB", "ALA", 1, 0, 0, 0), atom(1, "CA", "ALA", 1, 1.5, 0, 0), atom(2, "CB", "LEU", 5, 0, 3, 0), atom(3, "CG", "LEU", 5, 0, 3.5, 0.5)]
    a = build(rows)
    graph = bonds.graph(a)
    got = {(r.atoms_a[0], r.atoms_b[0]) for r in interactions.hydrophobic(a, graph).collect()}
    assert got == {(0, 2)} or got == {(0, 2), (1, 3)} or (0, 2) in got and len(got) <= 2


def test_every_hydrogen_bonds_once(spark):
    rows = [("s", 1, 10, 9.0, [170.0, 165.0]), ("s", 1, 11, 9.0, [160.0, 120.0]), ("s", 2, 10, 9.0, [90.0]), ("s", 3, 12, 9.0, [150.0]), ("s", 3, 13, 9.0, [150.0])]
    df = spark.createDataFrame(rows, "a_sid string, a_atom_idx int, b_atom_idx int, d2 double, angles array<double>")
    got = sorted((r.a_atom_idx, r.b_atom_idx, r.angle) for r in interactions.assign(df).collect())
    assert got == [(1, 10, 170.0), (1, 11, 120.0), (3, 12, 150.0)]


def test_geometry(spark):
    v = lambda *p: G.vec(*map(F.lit, p))
    one = spark.range(1).select(
        G.angle_at(v(0, 0, 0), v(1, 0, 0), v(0, 2, 0)).alias("right"), G.angle_at(v(0, 0, 0), v(0, 0, 0), v(1, 0, 0)).alias("none"),
        G.newell_normal(F.array(v(0, 0, 0), v(1, 0, 0), v(1, 1, 0), v(0, 1, 0))).alias("normal"), G.rotor_toward(v(0, 0, 0), v(-1.4, 0, 0), v(0, 5, 0)).alias("rotor"),
        G.planar_pair(v(0, 0, 0), v(-1.3, 0, 0), v(-2, 1, 0)).alias("pair"), G.outward(v(0, 0, 0), F.array(v(1, 0, 0), v(-1, 0, 0))).alias("cancel"), G.straddling_pair(v(0, 0, 0), v(1, 1, 0), v(1, -1, 0)).alias("straddle"),
    ).first()
    assert one.right == pytest.approx(90) and one.none == 0
    assert abs(one.normal.z) == pytest.approx(1)
    assert (one.rotor.x, one.rotor.y) == pytest.approx((-math.cos(math.radians(110)), math.sin(math.radians(110))))
    assert all(h.x == pytest.approx(0.5) for h in one.pair) and {round(h.y, 3) for h in one.pair} == {0.866, -0.866}
    assert one.cancel is None or one.cancel.x is None
    assert {round(h.z, 3) for h in one.straddle} == {round(s * math.sin(math.radians(54.75)), 3) for s in (1, -1)}


def test_operator_counts(spark):
    want = {"1": 1, "1,2,3": 3, "1-60": 60, "(1-60)(X0)": 60, "(1,2)(3-5)": 6, "P": 1, "": 0, "5-3": 1, "(1-2,7)(A)": 3}
    df = spark.createDataFrame([(k,) for k in want], "e string").select("e", scalars.count_operators(F.col("e")).alias("n"))
    assert {r.e: r.n for r in df.collect()} == want


CIF = """data_T
_cell.length_a 1
_pdbx_struct_assembly.id 1
_pdbx_struct_assembly.oligomeric_details 'dimeric thing'
_pdbx_struct_assembly_gen.assembly_id 1
_pdbx_struct_assembly_gen.oper_expression 1,2
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . GLY A -3 ? 0 0 0 1.0 5 1
ATOM 2 C CA . GLY A -3 ? 1.5 0 0 1.0 5 1
HETATM 3 O "O5'" A 017 B 7 C 4 4 4 0.5 9 1
HETATM 4 ? O . HOH B 8 . 9 9 9 1.0 9 1
ATOM 1 N N . GLY A -3 ? 7 7 7 1.0 5 2
#
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.atom_id
_chem_comp_atom.type_symbol
_chem_comp_atom.pdbx_aromatic_flag
017 C1 C N
017 "O5'" O N
017 H1 H N
#
loop_
_chem_comp_bond.comp_id
_chem_comp_bond.atom_id_1
_chem_comp_bond.atom_id_2
_chem_comp_bond.value_order
017 C1 "O5'" sing
017 "O5'" H1 sing
#
"""
PDB = """REMARK 350 BIOMOLECULE: 1
REMARK 350 AUTHOR DETERMINED BIOLOGICAL UNIT: TRIMERIC
REMARK 350   BIOMT1   1  1.0 0.0 0.0 0.0
REMARK 350   BIOMT1   2  1.0 0.0 0.0 0.0
REMARK 350   BIOMT1   3  1.0 0.0 0.0 0.0
REMARK 350 BIOMOLECULE: 2
REMARK 350   BIOMT1   9  1.0 0.0 0.0 0.0
MODEL        1
ATOM      1  CA AGLY B  -5A     11.104   6.134  -6.504  0.50 12.00           C
ENDMDL
MODEL        2
ATOM      1  CA  GLY B  -5      11.104   6.134  -6.504  1.00 12.00           C
ENDMDL
"""


def test_files(spark, tmp_path):
    (tmp_path / "T.cif").write_text(CIF)
    (tmp_path / "P.pdb").write_text(PDB)
    files = mmcif.files(spark, str(tmp_path))
    got = {(r.sid, r.atom_idx): r for r in mmcif.read_atoms(files).collect()}
    assert len(got) == 5
    assert (got["T", 0].resi, got["T", 0].icode, got["T", 0].chain) == (-3, None, "A")
    assert (got["T", 2].name, got["T", 2].icode, got["T", 2].is_hetatm, got["T", 2].altloc) == ("O5'", "C", True, "A")
    assert got["T", 3].element == "O"
    p = got["P", 0]
    assert (p.name, p.resi, p.icode, p.altloc, p.x, p.model) == ("CA", -5, "A", "A", 11.104, 1)
    assert {(r.sid, r.operator_count, r.oligomer) for r in mmcif.read_assemblies(files).collect()} == {("T", 2, "dimeric thing"), ("P", 3, "trimeric")}
    comp = mmcif.read_components(files)
    assert {(r.comp_id, r.atom_name, r.h_count) for r in comp["comp_atoms"].collect()} == {("017", "C1", 0), ("017", "O5'", 1), ("17", "C1", 0), ("17", "O5'", 1)}
    assert comp["comp_bonds"].where("comp_id = '017'").count() == 1
    structure = mmcif.read_structures(spark, str(tmp_path / "T.cif"))
    assert {r.ss for r in structure["atoms"].collect()} == {"C"}
    assert mmcif.backbone_only(structure["atoms"]).count() == 3 and mmcif.calpha_only(structure["atoms"]).count() == 1


def test_loop_reader():
    lines = ["loop_", "_x.a", "_x.b", "1 'two words'", ";many", "lines", ";", '"q\'s"', "#"]
    assert mmcif.read_loop(lines, "_x.") == (["a", "b"], [["1", "two words"], ["many\nlines", "q's"]])
    assert mmcif.read_loop(lines, "_y.") is None
    assert mmcif.read_value(["_a.b", "'c d'"], "_a.b") == "c d"


def component(atoms, bonded, aromatic=(), hydrogens=None):
    c = components.Component({a: a.rstrip("0123456789") for a in atoms}, set(aromatic), hydrogens or {}, list(atoms))
    for a, b, o in bonded:
        c.bonds.setdefault(a, {})[b] = o
        c.bonds.setdefault(b, {})[a] = o
    return c


def test_component_chemistry():
    acetate = component(["C1", "C2", "O1", "O2"], [("C1", "C2", "SING"), ("C2", "O1", "DOUB"), ("C2", "O2", "SING")], hydrogens={"O2": 1})
    assert components.charged_sites(acetate) == [(-1, ["O1", "O2"], "C2")]
    assert components.accepts(acetate, "O1") and components.donor(acetate, "O2") is None and components.hybridisation(acetate, "C2") == 2
    ester = component(["C1", "O1", "O2", "C2"], [("C1", "O1", "DOUB"), ("C1", "O2", "SING"), ("O2", "C2", "SING")])
    assert components.accepts(ester, "O1") and not components.accepts(ester, "O2")
    amine = component(["C1", "N1"], [("C1", "N1", "SING")], hydrogens={"N1": 3})
    assert components.charged_sites(amine) == [(1, ["N1"], "N1")] and components.donor(amine, "N1")[:2] == ("rotor", 3) and not components.accepts(amine, "N1")
    names = [f"C{i}" for i in range(1, 7)]
    ring = component([*names, "F1"], [(names[i], names[(i + 1) % 6], "AROM") for i in range(6)] + [("C1", "F1", "SING")], aromatic=names)
    assert components.aromatic_rings(ring) == [["C1", "C2", "C3", "C4", "C5", "C6"]] and ring.cycle("C1") and not components.accepts(ring, "F1")
    nitrile = component(["C1", "C2", "N1"], [("C1", "C2", "SING"), ("C2", "N1", "TRIP")])
    assert components.hybridisation(nitrile, "C2") == 1 and components.accepts(nitrile, "N1")
    phosphate = component(["P1", "O1", "O2", "O3"], [("P1", "O1", "DOUB"), ("P1", "O2", "SING"), ("P1", "O3", "SING")], hydrogens={"O2": 1})
    assert components.charged_sites(phosphate) == [(-1, ["O1", "O2", "O3"], None)] and components.acid_oxygen(phosphate, "O2")


def test_components_reach_the_detectors(spark, build):
    atoms = build([atom(0, "C2", "ACT", 1, 0, 0, 0, het=True), atom(1, "O1", "ACT", 1, 1.2, 0, 0, het=True), atom(2, "O2", "ACT", 1, -0.6, 1.1, 0, het=True), atom(3, "NZ", "LYS", 5, 4, 0, 0)])
    comp_atoms = spark.createDataFrame([("s", "ACT", n, n[0], False, 0, i) for i, n in enumerate(["C2", "O1", "O2"])], "sid string, comp_id string, atom_name string, element string, aromatic boolean, h_count int, ord int")
    comp_bonds = spark.createDataFrame([("s", "ACT", "C2", "O1", "DOUB"), ("s", "ACT", "C2", "O2", "SING")], "sid string, comp_id string, a string, b string, bond_order string")
    own = components.perceive(comp_atoms, comp_bonds)
    got = interactions.detect(atoms, kinds=("salt-bridge",), components=own).collect()
    assert [(r.atoms_a, r.atoms_b) for r in got] == [([3], [1, 2])]
    assert {r.atom_idx for r in roles.acceptors(atoms, own["roles"], bonds.graph(atoms, comp_bonds=own["bonds"])).collect()} == {1, 2}


def test_amide_hydrogens(build):
    a = build([atom(0, "N", "ALA", 1, 0, 0, 0), atom(1, "CA", "ALA", 1, 1.4, 0, 0), atom(2, "C", "ALA", 1, 2, 1.4, 0), atom(3, "O", "ALA", 1, 1, 2, 0), atom(4, "N", "GLY", 2, 3.3, 1.5, 0), atom(5, "N", "PRO", 3, 30, 0, 0)])
    got = {r.atom_idx: r for r in hydrogens.donors(a).collect()}
    assert set(got) == {0, 4}
    assert got[0]["antecedent"].x == pytest.approx(1.4) and got[0]["count"] == 3
    h = got[4].fixed[0]
    assert math.dist((h.x, h.y, h.z), (3.3, 1.5, 0)) == pytest.approx(1)


GRAPHS = {
    "path": [("A/1", "A/2"), ("A/2", "A/3"), ("A/3", "A/4")],
    "star": [("A/5", f"A/{i}") for i in (1, 2, 3, 10)],
    "two": [("A/1", "A/2"), ("B/-1", "B/2A")],
    "cycle": [("A/1", "A/2"), ("A/2", "A/3"), ("A/3", "A/4"), ("A/4", "A/1")],
}


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame([(g, a, b) for g, e in GRAPHS.items() for a, b in e], "sid string, source string, target string")


def test_graph_kernels(graphs):
    between = {(r.sid, r.id): r.betweenness for r in network.betweenness(graphs).collect()}
    assert between["path", "A/2"] == 2 and between["star", "A/5"] == 6 and between["cycle", "A/1"] == 0.5
    assert {(r.sid, r.id) for r in network.cut_residues(graphs).collect()} == {("path", "A/2"), ("path", "A/3"), ("star", "A/5")}
    assert {(r.sid, r.component, r.size) for r in network.components(graphs).collect()} >= {("two", "A/1", 2), ("two", "B/-1", 2), ("star", "A/1", 5)}
    route = sorted((r.sid, r.step, r.id) for r in network.shortest_path(graphs, "A/1", "A/3").collect())
    assert [x[2] for x in route if x[0] == "cycle"] == ["A/1", "A/2", "A/3"] and not [x for x in route if x[0] == "two"]
    spots = network.layouts(graphs, 20).collect()
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in spots)


def test_cut_nodes_and_betweenness_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(2, 9)
        near = [set() for _ in range(n)]
        for _ in range(r.randint(1, 12)):
            a, b = r.randrange(n), r.randrange(n)
            if a != b:
                near[a].add(b)
                near[b].add(a)
        near = [sorted(x) for x in near]
        parts = lambda drop: len({x for i, x in enumerate(network.component_labels([[v for v in near[u] if v != drop] if u != drop else [] for u in range(n)])) if i != drop})
        base = len(set(network.component_labels(near)))
        assert network.cut_nodes(near) == [u for u in range(n) if near[u] and parts(u) > base]
        want = np.zeros(n)
        for s in range(n):
            for t in range(s + 1, n):
                paths, todo = [], [[s]]
                while todo and not paths:
                    todo = [[*p, v] for p in todo for v in near[p[-1]] if v not in p]
                    paths = [p for p in todo if p[-1] == t]
                for p in paths:
                    for v in p[1:-1]:
                        want[v] += 1 / len(paths)
        assert network.brandes(near) == pytest.approx(want)


def test_surface(build):
    a = build([atom(0, "CA", "ALA", 1, 0, 0, 0), atom(1, "CA", "ALA", 2, 50, 0, 0), atom(2, "CB", "ALA", 2, 50, 0, 0.0001), atom(3, "O", "HOH", 3, 0, 0, 1, het=True)])
    got = {r.resi: r for r in sasa.residue_areas(a).collect()}
    whole = 4 * math.pi * (1.7 + 1.4) ** 2
    assert set(got) == {1, 2} and got[1].sasa == pytest.approx(whole, abs=0.01)
    assert got[2].sasa < 1.2 * whole and got[1].rsa == pytest.approx(whole / 129, abs=0.001)
    assert np.allclose(np.linalg.norm(sasa.sphere(), axis=1), 1)


def test_validation(spark):
    e = "sid string, kind string, source string, target string"
    p = spark.createDataFrame([("s", "k", "A/1", "A/2"), ("s", "k", "A/1", "A/3")], e)
    r = spark.createDataFrame([("s", "k", "A/1", "A/2"), ("t", "k", "A/1", "A/9")], e)
    got = {x.sid: x for x in validation.set_agreement(p, r).collect()}
    assert (got["s"].precision, got["s"].recall) == (0.5, 1.0) and (got["t"].precision, got["t"].recall, got["t"].f1) == (0.0, 0.0, 0.0)
    (s,) = validation.summary(validation.set_agreement(p, r)).collect()
    assert (s.n_predicted, s.n_reference, s.n_common, s.n_vacuous) == (2, 2, 1, 0) and s.micro_precision == 0.5
    assert "| k |" in reports.validation_markdown([s])
    assert validation.gate({"q3": 0.97, "mae": 7.0}, {"min_q3": 0.95, "max_mae": 6.0, "min_f1": 0.5}) == ["mae is 7.0, the limit is 6.0", "f1 is None, the limit is 0.5"]


def test_golden(spark, tmp_path):
    key = lambda n: {"chain": "A", "seq": n, "icode": None}
    (tmp_path / "X.dssp.json").write_text(json.dumps({"residues": [{**key(1), "ss": "P"}, {**key(2), "ss": "G"}], "hbonds": [{"donor": key(9), "acceptor": key(1)}]}))
    (tmp_path / "Y.dssp.json").write_text(json.dumps({"residues": [], "hbonds": []}))
    (tmp_path / "X.plip.json").write_text(json.dumps({"kinds": ["k"], "ligand_scoped": True, "interactions": [{"kind": "k", "a": key(5), "b": key(2)}]}))
    path = str(tmp_path / "*.dssp.json")
    assert {(r.resi, r.ss) for r in golden.secondary_structure(spark, path).collect()} == {(1, "P"), (2, "G")}
    assert [(r.sid, r.source, r.target) for r in golden.backbone_bonds(spark, path).collect()] == [("X", "A/1", "A/9")]
    edges, scope = golden.contacts(spark, str(tmp_path / "*.plip.json"))
    assert [(r.source, r.target) for r in edges.collect()] == [("A/2", "A/5")] and scope.first().ligand_scoped
    assert golden.manifest(spark, '[strata]\na = ["X", "Y"]\n').count() == 2 and golden.thresholds("min_q3 = 0.95") == {"min_q3": 0.95}


def test_reports(spark, tmp_path):
    rows = [Row(a=1, b=None, c="x"), Row(a=22, b=None, c="yy")]
    assert reports.table(rows, ["a", "b", "c"]) == " a  c\n 1  x\n22  yy\n"
    assert reports.tsv([], ["a", "b"]) == "a\tb\n" and json.loads(reports.json_array(rows))[1]["c"] == "yy"
    nodes = [Row(id="A/1", chain="A", resi=1, icode=None, resn="A<B", ss="C", degree=1)]
    edges = [Row(source="A/1", target="A/2", kind="k&l", count=1, min_distance=2.0, interchain=False, energy=1.0)]
    xml = reports.graphml(nodes, edges)
    assert "A&lt;B" in xml and "k&amp;l" in xml
    assert json.loads(reports.scene("1CRN", nodes))["root"]["kind"] == "root"
    n = spark.createDataFrame([("s", "A/1", "A", 1, None, "GLY", "C", 1)], "sid string, id string, chain string, resi int, icode string, resn string, ss string, degree int")
    e = spark.createDataFrame([("s", "A/1", "A/2", "k", 1, 2.004, False, 1.0)], "sid string, source string, target string, kind string, count long, min_distance double, interchain boolean, energy double")
    assert json.loads(reports.network_json(n, e).first().json)["edges"][0]["min_distance"] == 2.0
    assert "cut residues\n  none" in reports.analysis_text(1, 1, [], [], []) and reports.path_text([], "a", "b").startswith("no path")
    reports.write_records(e, str(tmp_path / "t"), "tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 1


def test_stream_of_structures(spark, build, tmp_path):
    from strandex.streaming import structures

    a = build([atom(0, "SG", "CYS", 1, 0, 0, 0), atom(1, "SG", "CYS", 9, 2.0, 0, 0)])
    a.write.parquet(str(tmp_path / "in"))
    q = structures.detect_stream(structures.arriving(spark, str(tmp_path / "in"), a.schema), interactions.disulfides, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_text_operators_are_optional():
    """Without the text subpackage the entry still has the structure queries."""
    import importlib
    import sys

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("strandex.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("strandex.llm", "corpus_pipeline", "__spark_entry__"))}
    sys.meta_path.insert(0, hide := Hide())
    try:
        entry = importlib.import_module("__spark_entry__")
        assert "disulfide" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    finally:
        sys.meta_path.remove(hide)
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(saved)


def test_constants():
    assert len(C.KINDS) == len(C.ENERGY) == 9 and len(C.AMINO) == len(C.MAX_ASA) == 20
    assert ("HIS", "ND1", "CE1") in C.side_chain_bonds()
