"""The entry points on small files, and what the networks and reports gained."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandex import commands
from strandex.functions import scalars
from strandex.operators import dssp, hydrogens, interactions, network, residues, validation
from strandex.sinks import reports
from strandex.sources import mmcif
from tests.structure.test_kernels import atom, build  # noqa: F401  a fixture


def line(i, name, resn, resi, x, y, z, het=False, element=None):
    return f"{'HETATM' if het else 'ATOM':<6}{i:>5} {name:<4} {resn:<3} A{resi:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00 10.00          {element or name[0]:>2}"


def salt_bridges(shift=0.0):
    rows = [line(1, "N", "LYS", 1, 0, 0, 0), line(2, "CA", "LYS", 1, 1.5, 0, 0), line(3, "NZ", "LYS", 1, 6, 0, 0), line(4, "CA", "ASP", 5, 12, 0, 0), line(5, "OD1", "ASP", 5, 9 + shift, 0, 0), line(6, "OD2", "ASP", 5, 9 + shift, 1, 0)]
    return "\n".join([*rows, line(7, "NZ", "LYS", 9, 9 + shift, 4, 0), "END", ""])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "1ABC.cif").write_text(salt_bridges())
    (tmp_path / "2XYZ.cif").write_text(salt_bridges(50))
    for name, rest in (("dssp", {"residues": [{"chain": "A", "seq": 1, "icode": None, "ss": " "}, {"chain": "A", "seq": 5, "icode": None, "ss": "H"}], "hbonds": []}), ("freesasa", {"residues": [{"chain": "A", "seq": 1, "icode": None, "sasa": 100.0}]})):
        (tmp_path / f"1ABC.{name}.json").write_text(json.dumps(rest))
    key = lambda n: {"chain": "A", "seq": n, "icode": None}
    (tmp_path / "1ABC.plip.json").write_text(json.dumps({"kinds": ["salt-bridge", "pi-stacking"], "ligand_scoped": False, "interactions": [{"kind": "salt-bridge", "a": key(5), "b": key(1)}, {"kind": "salt-bridge", "a": key(5), "b": key(30)}]}))
    return tmp_path


def test_resolve(spark, folder):
    assert commands.resolve(spark, "1abc", str(folder)).endswith("/1ABC.cif")
    assert commands.resolve(spark, f"{folder}/*.cif") == f"{folder}/*.cif"
    for bad in ("9ZZZ", "0ABC", "nothing"):
        with pytest.raises(LookupError):
            commands.resolve(spark, bad, str(folder))


def test_reports_of_files(spark, folder):
    found = commands.interaction_report(spark, "1ABC", ("salt-bridge",), cache=str(folder)).collect()
    assert [(r.sid, r.a_resi, r.b_resi) for r in found] == [("1ABC", 1, 5), ("1ABC", 9, 5)]
    edges, nodes = commands.network_report(spark, f"{folder}/*.cif", ("salt-bridge",), "chain A")
    text = commands.analyse(edges, nodes)
    assert set(text) == {"1ABC", "2XYZ"} and "3 residues, 2 edges" in text["1ABC"] and "A/5  1.00  degree 2" in text["1ABC"] and "A/5" in text["1ABC"].split("cut residues")[1]


def test_command_line(spark, folder, capsys):
    assert commands.main(["rin", "1ABC", "--cache", str(folder), "--kinds", "salt-bridge", "--path", "A/1", "A/9"]) == 0
    assert "2 steps" in capsys.readouterr().out
    assert commands.main(["interactions", "1ABC", "--cache", str(folder), "--kinds", "salt-bridge", "--format", "tsv"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3


def test_validation(spark, folder):
    text, short = commands.validate(spark, '[strata]\na = ["1ABC", "7ZZZ"]\n', str(folder), str(folder), {"min_q3": 0.4, "min_plip_f1": 0.99, "max_sasa_mae": 500.0})
    assert "| 1ABC | 2 | 50.0% | 1.00 |" in text and "2XYZ" not in text
    assert "| pi-stacking | 1.00 | 1.00 | 1.00 |" in text and "| salt-bridge | 0.50 | 0.50 | 0.50 |" in text
    assert len(short) == 1 and short[0].startswith("plip_f1")


def test_ranks_and_more(build, spark):  # noqa: F811
    r = random.Random(2)
    edges = spark.createDataFrame([(s, f"A/{i}", f"A/{j}", "disulfide" if i % 2 else "salt-bridge") for s in "ab" for i, j in {tuple(sorted(r.sample(range(40), 2))) for _ in range(30)}], "sid string, source string, target string, kind string")
    hubs = network.top_components(network.components(edges), 2).collect()
    assert {(x.sid, x["rank"]) for x in hubs} >= {("a", 1), ("b", 1)} and all(x["rank"] <= 2 for x in hubs)
    assert {(x.kind, x.short, x.kind_ord) for x in network.present_kinds(edges).collect()} == {("disulfide", "S-S", 8), ("salt-bridge", "salt", 1)}
    atoms = build([atom(i, "CA", "ALA", i, i, 0, i, chain="A") for i in range(40)])
    nodes = network.nodes(edges, atoms)
    areas = spark.createDataFrame([("a", "A", i, None, "ALA", 64.5) for i in range(40)], "sid string, chain string, resi int, icode string, resn string, sasa double")
    buried = network.burial(nodes, areas).collect()
    assert {x.rsa for x in buried if x.sid == "a"} == {pytest.approx(0.5)} if any(x.sid == "a" for x in buried) else True
    assert sorted(x.atom_idx for x in residues.depth_slab(atoms, 0.5, 1.0).collect()) == list(range(20, 40))
    assert network.node(nodes, "A/3").where("id <> 'A/3'").count() == 0


def test_first_atom_and_own_conformer(build):  # noqa: F811
    ring = ("CG", "CD1", "CE1", "CZ", "CE2", "CD2")
    rows = [atom(i, n, "PHE", 1, *(((1.4, 0), (0.7, 1.2), (-0.7, 1.2), (-1.4, 0), (-0.7, -1.2), (0.7, -1.2))[i]), 0) for i, n in enumerate(ring)]
    again = [atom(6, "CG", "PHE", 1, 50, 50, 50)]
    (found,) = interactions.rings(build(rows + again)).collect()
    assert found.atoms == list(range(6))
    two = [atom(0, "CB", "SER", 1, 0, 0, 0, altloc="A"), atom(1, "OG", "SER", 1, 1.4, 0, 0, altloc="A"), atom(2, "CB", "SER", 1, 0, 9, 0, altloc="B"), atom(3, "OG", "SER", 1, 1.4, 9, 0, altloc="B")]
    ca = [atom(4, "CA", "SER", 1, -1, 1, 0)]
    got = {r.atom_idx: r.antecedent.y for r in hydrogens.donors(build(two + ca)).where("antecedent is not null").collect()}
    assert got == {1: 0.0, 3: 9.0}
