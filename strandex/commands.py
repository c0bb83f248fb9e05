"""The entry points: contacts, networks and validation of structure files, as functions and as a command line.

    python -m strandex.commands interactions 1CRN --select "chain A"
    python -m strandex.commands rin "/corpus/*.cif.gz" --analyze
    python -m strandex.commands validate manifest.toml --golden golden --check thresholds.toml

An argument is a path, a glob, or the four-character id of a structure in the
folder of structures (``--cache``).  Nothing is fetched.
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.operators import components, interactions, network, validation
from strandex.plans import selection
from strandex.sinks import reports
from strandex.sources import golden, mmcif

_ID = re.compile(r"[1-9][A-Za-z0-9]{3}")


def is_structure_id(text: str) -> bool:
    return bool(_ID.fullmatch(text))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob of any of Spark's file systems has files."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def resolve(spark: SparkSession, argument: str, cache: str = "structures") -> str:
    """An existing path or glob as it is, an id as its file in the cache; anything else is an error."""
    if _exists(spark, argument):
        return argument
    if not is_structure_id(argument):
        raise LookupError(f"{argument!r} is neither an existing file nor a four-character id")
    path = f"{cache.rstrip('/')}/{argument.upper()}.cif"
    for found in (path, f"{path}.gz"):
        if _exists(spark, found):
            return found
    raise LookupError(f"{argument.upper()} isn't in {cache}; put its file there")


def contacts(structures: dict[str, DataFrame], kinds: Sequence[str] = C.KINDS, select: str | None = None) -> DataFrame:
    """The contacts of all structures, with what their component dictionaries say, narrowed to a selection."""
    atoms = structures["atoms"]
    own = components.perceive(structures["comp_atoms"], structures["comp_bonds"]) if "comp_atoms" in structures else None
    found = interactions.dedup_conformers(mmcif.kept(interactions.detect(atoms, kinds=tuple(kinds), components=own)), atoms)
    return found if select is None else interactions.touching(found, selection.select_some(select, atoms))


def interaction_report(spark: SparkSession, argument: str, kinds: Sequence[str] = C.KINDS, select: str | None = None, cache: str = "structures") -> DataFrame:
    """The report's records in order."""
    structures = mmcif.read_structures(spark, resolve(spark, argument, cache))
    return interactions.records(contacts(structures, kinds, select), structures["atoms"]).orderBy("sid", "kind_ord", *interactions.REPORT_ORDER[2:])


def analyse(edges: DataFrame, nodes: DataFrame) -> dict[str, str]:
    """The analysis text of each structure; what reaches the driver is a report's size for each."""
    sizes = {r.sid: r for r in edges.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    counts = {r.sid: r.n for r in nodes.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    of: dict[str, dict[str, list]] = {}
    for what, frame in (("components", network.top_components(network.components(edges), reports.TOP + 1)), ("hubs", network.top_hubs(nodes, network.betweenness(edges))), ("cuts", network.cut_residues(edges).orderBy("sid", "id"))):
        for r in sorted(frame.collect(), key=lambda r: r["rank"] if "rank" in r else 0):
            of.setdefault(r.sid, {}).setdefault(what, []).append(r)
    n_components = {r.sid: r.n for r in network.components(edges).groupBy("sid").agg(F.countDistinct("component").alias("n")).collect()}
    out = {}
    for sid in sorted(sizes):
        found = of.get(sid, {})
        out[sid] = reports.analysis_text(counts.get(sid, 0), sizes[sid].n, found.get("components", []), found.get("hubs", []), [r.id for r in found.get("cuts", [])], n_components[sid])
    return out


def network_report(spark: SparkSession, argument: str, kinds: Sequence[str] = C.KINDS, select: str | None = None, cache: str = "structures") -> tuple[DataFrame, DataFrame]:
    """Edges and nodes."""
    structures = mmcif.read_structures(spark, resolve(spark, argument, cache))
    edges = mmcif.kept(network.edges(contacts(structures, kinds, select), structures["atoms"]))
    return edges, mmcif.kept(network.nodes(edges, structures["atoms"]))


def validate(spark: SparkSession, manifest: str, folder: str, references: str, limits: dict[str, float] | None = None) -> tuple[str, list[str]]:
    """The validation report of a manifest's structures that are in ``folder``, and what falls short of the limits.

    All structures are predicted and compared in one job each; one that isn't
    there is skipped, as is a reference.
    """
    wanted = golden.manifest(spark, manifest).select("sid").distinct()
    structures = {k: df.join(F.broadcast(wanted), "sid", "left_semi") for k, df in mmcif.read_structures(spark, f"{folder.rstrip('/')}/*.cif*").items()}  # the manifest's ids
    path = lambda kind: p if _exists(spark, p := f"{references.rstrip('/')}/*.{kind}.json") else None
    dssp, area, plip = path("dssp"), path("freesasa"), path("plip")
    edges, scope = golden.contacts(spark, plip) if plip else (None, None)
    known = {"ss": golden.secondary_structure(spark, dssp) if dssp else None, "bonds": golden.backbone_bonds(spark, dssp) if dssp else None, "bond_scope": golden.bond_scope(spark, dssp) if dssp else None, "surface": golden.surface(spark, area) if area else None, "contacts": edges, "scope": scope}
    here = structures["atoms"].select("sid").distinct()
    known = {k: df.join(here, "sid", "left_semi") if df is not None else None for k, df in known.items()}
    predicted = {k: mmcif.kept(df) for k, df in validation.predict(structures).items()}
    entries, agreement = validation.compare(predicted, known)
    entries = mmcif.kept(entries)
    means = entries.agg(F.avg("q3").alias("q3"), F.avg("hbond_f1").alias("hbond_f1"), F.avg("mae").alias("sasa_mae")).first().asDict()
    kinds = validation.summary(agreement).orderBy("kind").collect() if agreement is not None else []
    means["plip_f1"] = sum(r.macro_f1 for r in kinds) / len(kinds) if kinds else None
    text = reports.entries_markdown(entries.orderBy("sid").collect()) + "\n" + (reports.validation_markdown(kinds) if kinds else "")
    return text, validation.gate(means, limits or {})


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandex")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("interactions", "rin"):
        p = commands.add_parser(name)
        p.add_argument("structure")
        p.add_argument("--kinds", nargs="+", choices=C.KINDS, default=list(C.KINDS))
        p.add_argument("--select")
        p.add_argument("--cache", default="structures")
        p.add_argument("--format", choices=("table", "tsv", "json"), default="table")
        if name == "rin":
            p.add_argument("--analyze", action="store_true")
            p.add_argument("--path", nargs=2, metavar=("FROM", "TO"))
    p = commands.add_parser("validate")
    p.add_argument("manifest")
    p.add_argument("--cache", default="structures")
    p.add_argument("--golden", default="golden")
    p.add_argument("--check", metavar="THRESHOLDS")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("strandex").getOrCreate()
    if given.command == "validate":
        with open(given.manifest, encoding="utf-8") as f:
            manifest = f.read()
        limits = golden.thresholds(open(given.check, encoding="utf-8").read()) if given.check else None
        text, short = validate(spark, manifest, given.cache, given.golden, limits)
        sys.stdout.write(text)
        sys.stderr.writelines(f"{x}\n" for x in short)
        return int(bool(short))
    written = {"table": reports.table, "tsv": reports.tsv, "json": lambda rows, columns: reports.json_array(rows)}[given.format]
    if given.command == "interactions":
        found = interaction_report(spark, given.structure, given.kinds, given.select, given.cache).drop("kind_ord")
    else:
        edges, nodes = network_report(spark, given.structure, given.kinds, given.select, given.cache)
        if given.analyze:
            sys.stdout.write("\n".join(f"{sid}\n{text}" for sid, text in analyse(edges, nodes).items()))
            return 0
        if given.path:
            routes: dict[str, list[str]] = {}
            for r in network.shortest_path(edges, *given.path).orderBy("sid", "step").collect():
                routes.setdefault(r.sid, []).append(r.id)
            sys.stdout.write("".join(f"{sid}: {reports.path_text(route, *given.path)}" for sid, route in routes.items()) or reports.path_text([], *given.path))
            return 0
        found = network.ordered(edges, nodes)
    try:
        sys.stdout.write(written(found.collect(), found.columns))
        sys.stdout.flush()
    except BrokenPipeError:  # the reader has seen enough
        sys.stderr.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
