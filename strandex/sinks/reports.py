"""Reports: records as table, TSV or JSON; networks as JSON, TSV, GraphML and scenes; analysis texts.

Distributed results go out with Spark's writers (``write_records``).  The
formatters below make single documents of one structure's network, whose size
is the structure's, not the corpus's.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

EDGE_COLUMNS = ("source", "target", "kind", "count", "min_distance", "interchain", "energy")


def write_records(records: DataFrame, path: str, form: str = "json") -> None:
    """Records of any size as partitioned files: 'json', 'tsv' or 'parquet'."""
    out = records.write.mode("overwrite")
    if form == "tsv":
        out.option("sep", "\t").option("header", True).csv(path)
    elif form in ("json", "parquet"):
        getattr(out, form)(path)
    else:
        raise ValueError(f"no format {form!r}")


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


#: Components and hubs that a report lists.
TOP = 10


def tsv(rows: Iterable[Row], columns: Sequence[str]) -> str:
    """A header even without rows."""
    return "".join("\t".join(x) + "\n" for x in [list(columns), *([_text(r[c]) for c in columns] for r in rows)])


def json_array(rows: Iterable[Row]) -> str:
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2)


def table(rows: Iterable[Row], columns: Sequence[str]) -> str:
    """Aligned columns; those without any value are left out, numbers stand to the right."""
    rows = list(rows)
    kept = [c for c in columns if not rows or any(r[c] is not None for r in rows)]
    right = {c for c in kept if rows and all(r[c] is None or isinstance(r[c], int | float) and not isinstance(r[c], bool) for r in rows)}
    cells = [kept, *([_text(r[c]) for c in kept] for r in rows)]
    wide = [max(len(x[i]) for x in cells) for i in range(len(kept))]
    return "".join("  ".join(v.rjust(w) if c in right else v.ljust(w) for v, w, c in zip(x, wide, kept, strict=True)).rstrip() + "\n" for x in cells)


def network_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """sid, json: one node-link document for each structure."""
    n = nodes.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("chain", "resi", "icode", "id", "resn", "ss", "degree"))).alias("nodes"))
    e = edges.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(*(F.round(c, 2).alias(c) if c in ("min_distance", "energy") else F.col(c) for c in EDGE_COLUMNS)))).alias("edges"))
    return n.join(e, "sid").select("sid", F.to_json(F.struct("nodes", "edges")).alias("json"))


def graphml(nodes: Iterable[Row], edges: Iterable[Row]) -> str:
    keys = [("node", c, t) for c, t in (("chain", "string"), ("resi", "int"), ("icode", "string"), ("resn", "string"), ("ss", "string"), ("degree", "int"))] + [("edge", c, t) for c, t in (("kind", "string"), ("count", "int"), ("min_distance", "double"), ("interchain", "boolean"), ("energy", "double"))]
    quoted = lambda v: escape(_text(v), {'"': "&quot;", "'": "&apos;"})
    value = lambda r, c: round(r[c], 2) if c in ("min_distance", "energy") else r[c]
    data = lambda kind, r: "".join(f'<data key="{kind}_{c}">{quoted(value(r, c))}</data>' for k, c, _ in keys if k == kind and r[c] is not None)
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines += [f'  <key id="{k}_{c}" for="{k}" attr.name="{c}" attr.type="{t}"/>' for k, c, t in keys]
    lines += ['  <graph edgedefault="undirected">']
    lines += [f'    <node id="{quoted(r["id"])}">{data("node", r)}</node>' for r in nodes]
    lines += [f'    <edge source="{quoted(r["source"])}" target="{quoted(r["target"])}">{data("edge", r)}</edge>' for r in edges]
    return "\n".join([*lines, "  </graph>", "</graphml>", ""])


def scene(source: str, nodes: Iterable[Row]) -> str:
    """A molecular scene document: the structure as cartoon, the network's residues as sticks."""
    path = source if "://" in source or "/" in source else f"https://files.rcsb.org/download/{source.lower()}.cif"
    picked = [{"auth_asym_id": r["chain"], "auth_seq_id": r["resi"], **({"pdbx_PDB_ins_code": r["icode"]} if r["icode"] else {})} for r in nodes]
    part = lambda selector, kind: {"kind": "component", "params": {"selector": selector}, "children": [{"kind": "representation", "params": {"type": kind}}]}
    structure = {"kind": "structure", "params": {"type": "model"}, "children": [part("polymer", "cartoon"), *([part(picked, "ball_and_stick")] if picked else [])]}
    root = {"kind": "root", "children": [{"kind": "download", "params": {"url": path}, "children": [{"kind": "parse", "params": {"format": "mmcif"}, "children": [structure]}]}]}
    return json.dumps({"metadata": {"version": "1"}, "root": root}, indent=2)


def analysis_text(n_nodes: int, n_edges: int, components: Sequence[Row], hubs: Sequence[Row], cuts: Sequence[str], n_components: int | None = None) -> str:
    """Sizes, the largest components, the hubs and the cut residues."""
    lines = [f"{n_nodes} residues, {n_edges} edges", "", "components"]
    lines += [f"  {r['component']}  {r['size']}" for r in components[:TOP]]
    if (more := (len(components) if n_components is None else n_components) - TOP) > 0:
        lines.append(f"  and {more} more")
    lines += ["", "hubs"] + [f"  {r['id']}  {r['betweenness']:.2f}  degree {r['degree']}" for r in hubs[:TOP]]
    return "\n".join([*lines, "", "cut residues", "  " + (", ".join(cuts) or "none"), ""])


def path_text(route: Sequence[str], start: str, goal: str) -> str:
    if not route:
        return f"no path from {start} to {goal}\n"
    return f"{len(route) - 1} steps\n" + " - ".join(route) + "\n"


def entries_markdown(entries: Sequence[Row]) -> str:
    """A row for each structure that was compared."""
    number = lambda v, form: "pending" if v is None else format(v, form)
    head = "| entry | residues | Q3 | H-bond F1 | SASA MAE | SASA residues |"
    rows = [f"| {r['sid']} | {r['n_residues'] or 0} | {number(r['q3'], '.1%')} | {number(r['hbond_f1'], '.2f')} | {number(r['mae'], '.2f')} | {r['n_surface'] or '-'} |" for r in entries]
    return "\n".join([head, "|" + " --- |" * 6, *rows, ""])


def validation_markdown(summary: Sequence[Row]) -> str:
    head = "| kind | precision | recall | F1 | micro F1 | predicted | reference | entries | vacuous |"
    rows = [f"| {r['kind']} | {r['macro_precision']:.2f} | {r['macro_recall']:.2f} | {r['macro_f1']:.2f} | {r['micro_f1']:.2f} | {r['n_predicted']} | {r['n_reference']} | {r['n_entries']} | {r['n_vacuous']} |" for r in summary]
    return "\n".join([head, "|" + " --- |" * 9, *rows, ""])
