"""Structure files (mmCIF, PDB) as tables.

A file is one structure and one row of the scan; parsing is a flat map over
files in Arrow batches, so a corpus of files is read by all executors.  Only
the first model is read.  Residue numbers keep their sign.  Symmetry records
are never looked at, so files with conflicting ones load as they are.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.functions import scalars
from strandex.operators import dssp, residues

_TOKEN = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+")
ATOMS = "sid string, atom_idx int, serial long, name string, element string, resn string, resi int, chain string, icode string, is_hetatm boolean, altloc string, occupancy double, b_factor double, model int, x double, y double, z double"
PDB_ID = r"^[1-9][A-Za-z0-9]{3}$"


def tokens(line: str) -> list[str]:
    """The words of a line; quotes keep spaces together and are taken off."""
    return [t[1:-1] if len(t) > 1 and t[0] in "'\"" and t[-1] == t[0] else t for t in _TOKEN.findall(line)]


def read_loop(lines: list[str], prefix: str) -> tuple[list[str], list[list[str]]] | None:
    """Columns (without the prefix) and rows of the first loop whose first column has the prefix."""
    for i, line in enumerate(lines):
        if line.strip() == "loop_" and i + 1 < len(lines) and lines[i + 1].strip().startswith(prefix):
            at, columns = i + 1, []
            while at < len(lines) and lines[at].strip().startswith("_"):
                columns.append(lines[at].split()[0].removeprefix(prefix))
                at += 1
            rows, held = [], []
            while at < len(lines) and not lines[at].startswith(("#", "_", "loop_", "data_")):
                if lines[at].startswith(";"):  # a value over several lines
                    value = [lines[at][1:]]
                    at += 1
                    while at < len(lines) and not lines[at].startswith(";"):
                        value.append(lines[at])
                        at += 1
                    held.append("\n".join(value))
                else:
                    held += tokens(lines[at])
                at += 1
                while len(held) >= len(columns) > 0:
                    rows.append(held[: len(columns)])
                    held = held[len(columns) :]
            return columns, rows
    return None


def read_value(lines: list[str], item: str) -> str | None:
    """The value of a single record, on its line or the next."""
    for i, line in enumerate(lines):
        words = tokens(line)
        if words and words[0] == item:
            if len(words) > 1:
                return words[1]
            if i + 1 < len(lines):
                return lines[i + 1].lstrip(";").strip() if lines[i + 1].startswith(";") else next(iter(tokens(lines[i + 1])), None)
    return None


def records(lines: list[str], prefix: str, names: list[str]) -> list[dict[str, str | None]]:
    """Rows of a category, written as a loop or as single values; . and ? are null."""
    clean = lambda v: None if v in (None, ".", "?") else v
    if found := read_loop(lines, prefix):
        columns, rows = found
        at = {c: i for i, c in enumerate(columns)}
        return [{n: clean(r[at[n]]) if n in at else None for n in names} for r in rows]
    one = {n: clean(read_value(lines, prefix + n)) for n in names}
    return [one] if any(v is not None for v in one.values()) else []


def _number(text: str | None, kind, other=None):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return other


def atom_rows(sid: str, text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    if any(line.startswith("_atom_site.") for line in lines):
        names = ["group_PDB", "id", "type_symbol", "label_atom_id", "auth_atom_id", "label_alt_id", "label_comp_id", "auth_comp_id", "label_asym_id", "auth_asym_id", "label_seq_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
        rows = records(lines, "_atom_site.", names)
        first = rows[0]["pdbx_PDB_model_num"] if rows else None
        for k, r in enumerate(x for x in rows if x["pdbx_PDB_model_num"] == first):
            yield (
                sid, k, _number(r["id"], int), r["label_atom_id"] or r["auth_atom_id"], r["type_symbol"], r["auth_comp_id"] or r["label_comp_id"], _number(r["auth_seq_id"] or r["label_seq_id"], int, 0),
                r["auth_asym_id"] or r["label_asym_id"], r["pdbx_PDB_ins_code"], r["group_PDB"] == "HETATM", r["label_alt_id"], _number(r["occupancy"], float, 1.0), _number(r["B_iso_or_equiv"], float, 0.0),
                _number(first, int, 1), _number(r["Cartn_x"], float), _number(r["Cartn_y"], float), _number(r["Cartn_z"], float),
            )
        return
    k, model = 0, 1
    for line in lines:
        if line.startswith("MODEL"):
            model = _number(line[10:14], int, 1)
        elif line.startswith("ENDMDL"):
            return
        elif line.startswith(("ATOM", "HETATM")):
            line = line.ljust(80)
            yield (sid, k, _number(line[6:11], int), line[12:16].strip(), line[76:78].strip() or None, line[17:20].strip(), _number(line[22:26], int, 0), line[21].strip() or "A", line[26].strip() or None, line.startswith("HETATM"), line[16].strip() or None, _number(line[54:60], float, 1.0), _number(line[60:66], float, 0.0), model, *(_number(line[c : c + 8], float) for c in (30, 38, 46)))
            k += 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """sid (the file's stem) and text of every file of a path or glob (.gz too)."""
    raw = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(cif|pdb|ent|mmcif)?(\.gz)?$", "")
    return raw.select(stem.alias("sid"), F.col("value").alias("text"))


def _table(df: DataFrame, rows, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for sid, text in zip(pdf["sid"], pdf["text"], strict=True):
                found = list(rows(sid, text))
                if found:
                    yield pd.DataFrame(found, columns=names).astype({n: "object" for n in names})

    return df.mapInPandas(run, schema)


def read_atoms(df: DataFrame, policy: str = "all") -> DataFrame:
    """Atoms of the files, elements inferred where they are missing, under an altloc policy."""
    raw = _table(df, atom_rows, ATOMS)
    return residues.altloc(raw.withColumn("element", scalars.infer_element(F.col("element"), F.col("name"))), policy)


def kept(df: DataFrame) -> DataFrame:
    """The frame checkpointed in the shared folder, so what is built on it neither parses files again nor plans that again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:  # local mode alone has a temporary folder
            base = tempfile.mkdtemp(prefix="strandex-") if context.master.startswith("local") else f"{df.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strandex-shared"
        context.setCheckpointDir(base)
    return df.checkpoint()


def read_structures(spark: SparkSession, path: str, policy: str = "occupancy") -> dict[str, DataFrame]:
    """Atoms with secondary structure, backbone bonds, components and assemblies of every file, each kept in the shared folder."""
    source = files(spark, path)
    atoms, bonds = dssp.assign(kept(read_atoms(source, policy)))
    components = {k: kept(df) for k, df in read_components(source).items()}
    return {"atoms": kept(atoms), "bonds": kept(bonds), **components, "assemblies": read_assemblies(source)}


def backbone_only(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.col("name").isin("CA", "C", "N", "O"))


def calpha_only(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.col("name") == "CA")


def overlong(atoms: DataFrame) -> DataFrame:
    """Identifiers longer than the formats' columns, once each: a quality report."""
    found = atoms.select("sid", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(n).alias("most")) for c, n in (("name", 4), ("resn", 6), ("chain", 4))))).alias("f"))
    return found.where("length(f.value) > f.most").select("sid", "f.*").distinct()


def component_rows(sid: str, text: str) -> Iterator[tuple]:
    """('atom', comp, name, element, aromatic, hydrogens, ord) and ('bond', comp, a, b, order) of the dictionary.

    Hydrogens are counted at the atoms that carry them.  An id that reads as a
    number also goes by its plain form.
    """
    lines = text.splitlines()
    atoms = records(lines, "_chem_comp_atom.", ["comp_id", "atom_id", "type_symbol", "pdbx_aromatic_flag"])
    bonds = records(lines, "_chem_comp_bond.", ["comp_id", "atom_id_1", "atom_id_2", "value_order"])
    element = {(r["comp_id"], r["atom_id"]): (r["type_symbol"] or "").upper() for r in atoms}
    light = {k for k, e in element.items() if e in ("H", "D")}
    carried: dict[tuple, int] = {}
    heavy = []
    for b in bonds:
        p, q = (b["comp_id"], b["atom_id_1"]), (b["comp_id"], b["atom_id_2"])
        if (p in light) != (q in light):
            carried[q if p in light else p] = carried.get(q if p in light else p, 0) + 1
        elif p not in light:
            heavy.append((p[0], p[1], q[1], (b["value_order"] or "SING").upper()))
    known = {r["comp_id"] for r in atoms}

    def ids(comp):
        yield comp
        plain = _number(comp, float)
        if plain is not None and plain == plain and abs(plain) < 1e15:
            short = repr(int(plain)) if plain == int(plain) else repr(plain)
            if short not in known:
                yield short

    for k, r in enumerate(atoms):
        key = (r["comp_id"], r["atom_id"])
        if key not in light and None not in key:
            for comp in ids(key[0]):
                yield (sid, "atom", comp, key[1], element[key], None, (r["pdbx_aromatic_flag"] or "N").upper() == "Y", carried.get(key, 0), k)
    for comp, a, b, order in heavy:
        for name in ids(comp):
            yield (sid, "bond", name, a, b, order, False, 0, 0)


def read_components(df: DataFrame) -> dict[str, DataFrame]:
    rows = _table(df, component_rows, "sid string, what string, comp_id string, a string, b string, bond_order string, aromatic boolean, h_count int, ord int")
    return {
        "comp_atoms": rows.where("what = 'atom'").select("sid", "comp_id", F.col("a").alias("atom_name"), F.col("b").alias("element"), "aromatic", "h_count", "ord"),
        "comp_bonds": rows.where("what = 'bond'").select("sid", "comp_id", "a", "b", "bond_order"),
    }


def assembly_rows(sid: str, text: str) -> Iterator[tuple]:
    """(sid, generator expression, oligomer): of the first assembly, by number 1 where there is one."""
    lines = text.splitlines()
    if any(line.startswith("_pdbx_struct_assembly_gen.") for line in lines):
        gen = records(lines, "_pdbx_struct_assembly_gen.", ["assembly_id", "oper_expression"])
        details = {r["id"]: r["oligomeric_details"] for r in records(lines, "_pdbx_struct_assembly.", ["id", "oligomeric_details"])}
        if gen:
            primary = "1" if any(r["assembly_id"] == "1" for r in gen) else gen[0]["assembly_id"]
            for r in gen:
                if r["assembly_id"] == primary and r["oper_expression"]:
                    yield (sid, r["oper_expression"], details.get(primary))
        return
    first, most, author, software = None, 0, None, None
    for line in lines:
        if not line.startswith("REMARK 350"):
            continue
        body = line[10:].strip()
        if body.startswith("BIOMOLECULE:"):
            first = body if first is None else first
            if body != first:
                break
        elif body.startswith("AUTHOR DETERMINED BIOLOGICAL UNIT:"):
            author = body.partition(":")[2].strip().lower() or author
        elif body.startswith("SOFTWARE DETERMINED QUATERNARY STRUCTURE:"):
            software = body.partition(":")[2].strip().lower() or software
        elif body.startswith("BIOMT1"):
            most = max(most, _number(body.split()[1], int, 0))
    if most:
        yield (sid, f"1-{most}", author or software)


def read_assemblies(df: DataFrame) -> DataFrame:
    """sid, operator_count, oligomer of structures whose assembly needs more than one operator."""
    rows = _table(df, assembly_rows, "sid string, expression string, oligomer string")
    counted = rows.select("sid", "oligomer", scalars.count_operators(F.col("expression")).alias("n"))
    return counted.groupBy("sid").agg(F.max("n").alias("operator_count"), F.max("oligomer").alias("oligomer")).where("operator_count > 1")
