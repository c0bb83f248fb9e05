"""Residue interaction networks: edges, nodes, and what graph analysis says of them.

Edges and degrees are plain aggregations.  Components, betweenness, cut nodes
and routes are kernels over one structure's graph at a time (a structure has
some thousand residues), run for all structures in parallel.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import scalars
from strandex.operators import kernels

_KEY = ("chain", "resi", "icode")


def edges(found: DataFrame, atoms: DataFrame) -> DataFrame:
    """sid, source, target, kind, count, min_distance, interchain, energy: one for each residue pair and kind.

    The first atom of a side stands for its residue; the lower residue (chain,
    number, insertion code, none first) is the source.
    """
    def kernel(contacts, table):
        s = kernels.Structure(table)
        return _edges(s, contacts.column("kind").combine_chunks(), *(contacts.column(c).to_numpy() for c in ("a_idx", "b_idx", "distance")))

    small = found.select("sid", "kind", F.col("distance").cast("double").alias("distance"), F.col("atoms_a")[0].alias("a_idx"), F.col("atoms_b")[0].alias("b_idx"))
    return kernels.with_atoms(small, atoms, kernel, _EDGES, ("sid", "atom_idx", *_KEY))


def detected_edges(atoms: DataFrame, scale: float = 1.0, kinds: tuple[str, ...] = C.KINDS, halogens: tuple[str, ...] = C.HALOGENS) -> DataFrame:
    """``edges`` of the contacts that ``interactions.detect`` finds without components.

    The contacts stay in the task that finds them, so they aren't shuffled and
    the atoms are read once.  Who reads the edges twice makes them twice.
    """
    def kernel(s):
        found = kernels.contacts(s, kinds, halogens)
        return _edges(s, found["kind"], *(pc.list_element(found[c], 0).to_numpy(zero_copy_only=False) for c in ("atoms_a", "atoms_b")), found["distance"].to_numpy())

    return kernels.per_structure(atoms, kernel, _EDGES, scale)


_EDGES = "source string, target string, kind string, count long, min_distance double, interchain boolean, energy double"


def _edges(s: kernels.Structure, kind: pa.Array, a_idx: np.ndarray, b_idx: np.ndarray, distance: np.ndarray) -> dict:
    kinds = pc.dictionary_encode(kind)
    a, b = s.places(a_idx), s.places(b_idx)
    rows = np.flatnonzero((a >= 0) & (b >= 0))
    rows = rows[s.rank[a[rows]] != s.rank[b[rows]]]
    swap = s.rank[b[rows]] < s.rank[a[rows]]
    low, high = np.where(swap, b[rows], a[rows]), np.where(swap, a[rows], b[rows])
    kind, distance = kinds.indices.to_numpy()[rows], distance[rows]
    least = kernels.first_rows(s.rank[low], s.rank[high], kind, by=(distance,))
    code = lambda x: (s.rank[low[x]] * s.n + s.rank[high[x]]) * len(kinds.dictionary) + kind[x]  # noqa: E731  ascending along least
    count = np.bincount(np.searchsorted(code(least), code(slice(None))), minlength=len(least))
    low, high, kind = low[least], high[least], kind[least]
    energy = np.array([C.ENERGY.get(k, np.nan) for k in kinds.dictionary.to_pylist()], float)
    return {
        "source": s.node.take(pa.array(low)), "target": s.node.take(pa.array(high)), "kind": kinds.dictionary.take(pa.array(kind)), "count": count, "min_distance": distance[least],
        "interchain": s.key[low, 0] != s.key[high, 0], "energy": pa.array(energy[kind] * count, from_pandas=True),
    }


def nodes(edges_: DataFrame, atoms: DataFrame) -> DataFrame:
    """sid, id, chain, resi, icode, resn, ss, degree (distinct partners) of every residue with an edge."""
    ss = F.col("ss") if "ss" in atoms.columns else F.lit("C")
    table = atoms.select("sid", "atom_idx", *_KEY, "resn", ss.alias("ss"))

    def kernel(links, table):
        s = kernels.Structure(table)
        ends = [links.column(c).combine_chunks() for c in ("source", "target")]
        ids = pc.dictionary_encode(pa.concat_arrays(ends))
        n, codes = len(ids.dictionary), ids.indices.to_numpy()
        pairs = np.unique(codes.astype(np.int64) * n + np.roll(codes, len(codes) // 2))
        first = pc.index_in(ids.dictionary, s.node)  # the first of several
        here = np.flatnonzero(pc.is_valid(first).to_numpy(zero_copy_only=False))
        rows = pa.array(first.take(pa.array(here)), pa.int32())
        return {"id": ids.dictionary.take(pa.array(here)), **{c: s.column(c).take(rows) for c in (*_KEY, "resn", "ss")}, "degree": np.bincount(pairs // n, minlength=n)[here]}

    kind = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return kernels.with_atoms(edges_.select("sid", "source", "target"), table, kernel, f"id string, {', '.join(f'{c} {kind[c]}' for c in (*_KEY, 'resn', 'ss'))}, degree long", tuple(table.columns))


def filter_edges(edges_: DataFrame, kind: str | None = None, interchain: bool | None = None) -> DataFrame:
    if kind is not None:
        edges_ = edges_.where(F.col("kind") == kind)
    return edges_ if interchain is None else edges_.where(F.col("interchain") == interchain)


def adjacency(edges_: DataFrame) -> DataFrame:
    """The simple graph, both ways."""
    one = edges_.select("sid", "source", "target")
    return one.union(one.select("sid", "target", "source")).where("source <> target").distinct()


def _graph(pdf: pd.DataFrame) -> tuple[list[str], list[list[int]]]:
    """Names in residue order and sorted neighbour lists."""
    names = sorted({*pdf["source"], *pdf["target"]}, key=_order)
    at = {x: i for i, x in enumerate(names)}
    out: list[set[int]] = [set() for _ in names]
    for a, b in zip(pdf["source"].map(at), pdf["target"].map(at), strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return names, [sorted(x) for x in out]


def _order(name: str) -> tuple:
    chain, _, rest = name.rpartition("/")
    digits = len(rest)
    while digits and not rest[:digits].lstrip("-").isdigit():
        digits -= 1
    return (chain, int(rest[:digits]) if digits else 0, rest[digits:])


def component_labels(near: list[list[int]]) -> list[int]:
    label = [-1] * len(near)
    for s in range(len(near)):
        if label[s] < 0:
            label[s] = s
            todo = [s]
            while todo:
                for v in near[todo.pop()]:
                    if label[v] < 0:
                        label[v] = s
                        todo.append(v)
    return label


def brandes(near: list[list[int]], block: int = 64) -> np.ndarray:
    """Betweenness of an unweighted, undirected graph: every pair once, not normalised; a block of sources at once, level by level."""
    n = len(near)
    total, size = np.zeros(n), np.array([len(x) for x in near], np.int64)
    starts, flat = np.cumsum(size) - size, np.array([v for x in near for v in x], np.int64)
    for lo in range(0, n, block):
        k = min(n, lo + block) - lo
        # one place for each source and node; a step goes along the edges of the level's places only
        depth, paths = np.full(k * n, -1, np.int32), np.zeros(k * n)
        here, level, steps = np.arange(k) * n + np.arange(lo, lo + k), 0, []
        depth[here], paths[here] = 0, 1
        while len(here):
            node = here % n
            count = size[node]
            out = np.repeat(here, count)
            to = flat[np.arange(len(out)) + np.repeat(starts[node] - (np.cumsum(count) - count), count)] + np.repeat(here - node, count)
            new = depth[to] < 0
            out, to = out[new], to[new]
            level += 1
            depth[to] = level
            np.add.at(paths, to, paths[out])
            steps.append((out, to))
            here = np.flatnonzero(depth == level)
        share = np.zeros(k * n)
        for out, to in reversed(steps):
            np.add.at(share, out, paths[out] * ((1 + share[to]) / paths[to]))
        share = share.reshape(k, n)
        share[np.arange(k), np.arange(lo, lo + k)] = 0
        total += share.sum(0)
    return total / 2


def cut_nodes(near: list[list[int]]) -> list[int]:
    """Articulation points by low links, without recursion."""
    n = len(near)
    seen, low, cut = [-1] * n, [0] * n, set()
    clock = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            u, up, rest = stack[-1]
            v = next(rest, None)
            if v is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if p == root:
                        children += 1
                    elif low[u] >= seen[p]:
                        cut.add(p)
            elif seen[v] < 0:
                seen[v] = low[v] = clock
                clock += 1
                stack.append((v, u, iter(near[v])))
            elif v != up:
                low[u] = min(low[u], seen[v])
        if children > 1:
            cut.add(root)
    return sorted(cut)


def route(near: list[list[int]], start: int, goal: int) -> list[int]:
    """A shortest route; of several the one that breadth-first search in node order finds first."""
    before = {start: -1}
    todo = deque([start])
    while todo and goal not in before:
        u = todo.popleft()
        for v in near[u]:
            if v not in before:
                before[v] = u
                todo.append(v)
    if goal not in before:
        return []
    out = [goal]
    while before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return out[::-1]


def layout(near: list[list[int]], steps: int = 300) -> np.ndarray:
    """Fruchterman-Reingold from a circle, cooling by 0.95 a step, in the unit square."""
    n = len(near)
    turn = 2 * np.pi * np.arange(n) / max(1, n)
    p = 0.5 + 0.5 * np.column_stack((np.cos(turn), np.sin(turn)))
    k, heat = np.sqrt(1 / max(1, n)), 0.1
    a, b = np.array([(u, v) for u in range(n) for v in near[u] if u < v], int).reshape(-1, 2).T
    for _ in range(steps):
        move = np.zeros_like(p)
        for lo in range(0, n, 512):  # blocks of rows: memory stays bounded
            x, y = (p[lo : lo + 512, None, c] - p[None, :, c] for c in (0, 1))
            push = k * k / np.maximum(x * x + y * y, 1e-8)
            move[lo : lo + 512, 0], move[lo : lo + 512, 1] = (x * push).sum(1), (y * push).sum(1)
        d = p[a] - p[b]
        r = np.maximum(np.sqrt((d * d).sum(-1)), 1e-4)[:, None]
        np.add.at(move, a, -d * r / k)
        np.add.at(move, b, d * r / k)
        size = np.maximum(np.sqrt((move * move).sum(-1)), 1e-9)[:, None]
        p = p + move / size * np.minimum(size, heat)
        heat *= 0.95
    lo, wide = p.min(0) if n else 0, np.maximum(np.ptp(p, axis=0), 1e-9) if n else 1
    return (p - lo) / wide


def _frame(sid, **columns) -> pd.DataFrame:
    """Rows of one structure, in plain Python values."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({"sid": [sid] * n, **columns}).astype(object)


def _per_structure(edges_: DataFrame, kernel, schema: str) -> DataFrame:
    kind = edges_.schema["sid"].dataType.simpleString()
    n = int(edges_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = edges_.select("sid", "source", "target").repartition(n, "sid")  # few rows, much work: not to be put together again
    return spread.groupBy("sid").applyInPandas(lambda pdf: kernel(pdf["sid"].iloc[0], *_graph(pdf)), f"sid {kind}, {schema}")


def components(edges_: DataFrame) -> DataFrame:
    """sid, id, component (the first node of it in residue order), size."""
    def kernel(sid, names, near):
        label = component_labels(near)
        size = np.bincount(label, minlength=len(names)) if names else []
        return _frame(sid, id=names, component=[names[x] for x in label], size=[int(size[x]) for x in label])

    return _per_structure(edges_, kernel, "id string, component string, size long")


def betweenness(edges_: DataFrame) -> DataFrame:
    return _per_structure(edges_, lambda sid, names, near: _frame(sid, id=names, betweenness=brandes(near).tolist()), "id string, betweenness double")


def cut_residues(edges_: DataFrame) -> DataFrame:
    return _per_structure(edges_, lambda sid, names, near: _frame(sid, id=[names[x] for x in cut_nodes(near)]), "id string")


def shortest_path(edges_: DataFrame, start: str, goal: str) -> DataFrame:
    """sid, step, id along the route in every structure that has both residues connected."""
    def kernel(sid, names, near):
        at = {x: i for i, x in enumerate(names)}
        found = route(near, at[start], at[goal]) if start in at and goal in at else []
        return _frame(sid, step=list(range(len(found))), id=[names[x] for x in found])

    return _per_structure(edges_, kernel, "step long, id string")


def bfs_distance(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    """sid, id, distance from each structure's start (sid, start)."""
    joined = edges_.select("sid", "source", "target").join(starts, "sid")
    kind = edges_.schema["sid"].dataType.simpleString()

    def kernel(pdf):
        names, near = _graph(pdf)
        at = {x: i for i, x in enumerate(names)}
        depth = [-1] * len(names)
        todo = deque()
        if (s := pdf["start"].iloc[0]) in at:
            depth[at[s]] = 0
            todo.append(at[s])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if depth[v] < 0:
                    depth[v] = depth[u] + 1
                    todo.append(v)
        seen = [i for i, d in enumerate(depth) if d >= 0]
        return _frame(pdf["sid"].iloc[0], id=[names[i] for i in seen], distance=[depth[i] for i in seen])

    return joined.groupBy("sid").applyInPandas(kernel, f"sid {kind}, id string, distance long")


def layouts(edges_: DataFrame, steps: int = 300) -> DataFrame:
    def kernel(sid, names, near):
        p = layout(near, steps)
        return _frame(sid, id=names, x=p[:, 0].tolist(), y=p[:, 1].tolist())

    return _per_structure(edges_, kernel, "id string, x double, y double")


def backbone_graph(table: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (all residue runs with degree: in and out, parallel ones counted) and directed edges acceptor to donor."""
    links = bonds.select("sid", F.col("acceptor").alias("source"), F.col("donor").alias("target"), "energy")
    ends = links.select("sid", F.col("source").alias("run")).unionAll(links.select("sid", "target")).groupBy("sid", "run").agg(F.count("*").alias("degree"))
    return table.select("sid", "run", "chain", "resi", "icode", "resn").join(ends, ["sid", "run"], "left").fillna(0, ["degree"]), links


def below_energy(links: DataFrame, limit: float) -> DataFrame:
    return links.where(F.col("energy") < limit)


def weak_components(links: DataFrame) -> DataFrame:
    """Components of the backbone graph, edges taken both ways."""
    return components(links.select("sid", F.col("source").cast("string"), F.col("target").cast("string")))


def motifs(nodes_: DataFrame, links: DataFrame, ss: DataFrame, least: int = 3) -> DataFrame:
    """sid, motif, start, size: helix ladders (chains of bonds four apart), sheet ladders (bonds both ways over more than four), turns (degree 3 or more in a turn).

    A ladder is a run of starts i, i + 4, i + 8 ...: an island of consecutive
    steps, so it needs no walk that could go in circles.
    """
    four = links.where("abs(target - source) = 4").select("sid", F.least("source", "target").alias("i")).distinct()
    w = Window.partitionBy("sid", F.expr("i % 4")).orderBy("i")
    islands = four.withColumn("island", F.col("i") - 4 * F.row_number().over(w))
    helix = islands.groupBy("sid", F.expr("i % 4").alias("phase"), "island").agg(F.min("i").alias("start"), (F.count("*") + 1).alias("size")).where(F.col("size") >= least).select("sid", F.lit("helix").alias("motif"), "start", "size")
    back = links.select("sid", F.col("target").alias("source"), F.col("source").alias("target"))
    sheet = links.select("sid", "source", "target").join(back, ["sid", "source", "target"]).where("target - source > 4").distinct().select("sid", F.lit("sheet").alias("motif"), F.col("source").alias("start"), F.lit(2).cast("long").alias("size"))
    turn = nodes_.where("degree >= 3").join(ss.where("ss = 'T'"), ["sid", "run"]).select("sid", F.lit("turn").alias("motif"), F.col("run").alias("start"), F.lit(1).cast("long").alias("size"))
    return helix.unionByName(sheet).unionByName(turn)


def top_hubs(nodes_: DataFrame, betweenness_: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest betweenness, then degree, then residue order, of each structure; rank counts from 1."""
    best = Window.partitionBy("sid").orderBy(F.desc("betweenness"), F.desc("degree"), *_KEY)
    return nodes_.join(betweenness_, ["sid", "id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_components(components_: DataFrame, k: int = 10) -> DataFrame:
    """The k largest components of each structure; rank counts from 1, ties go by the name of the first node."""
    best = Window.partitionBy("sid").orderBy(F.desc("size"), "component")
    return components_.groupBy("sid", "component").agg(F.count("*").alias("size")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def burial(nodes_: DataFrame, areas: DataFrame) -> DataFrame:
    """The nodes with the summed surface of their residue (sid, key, resn, sasa) and its share of the largest one."""
    sums = areas.select("sid", scalars.node_id(*map(F.col, _KEY)).alias("id"), "sasa").groupBy("sid", "id").agg(F.sum("sasa").alias("sasa"))
    joined = nodes_.join(sums, ["sid", "id"], "left").withColumn("sasa", F.coalesce("sasa", F.lit(0.0)))
    return joined.withColumn("rsa", scalars.relative_sasa(F.col("sasa"), F.col("resn")))


def present_kinds(edges_: DataFrame) -> DataFrame:
    """sid, kind, short label and place in the display order of the kinds that a structure has."""
    return edges_.select("sid", "kind").distinct().select("sid", "kind", scalars.kind_short(F.col("kind")).alias("short"), scalars.kind_order(F.col("kind")).alias("kind_ord"))


def ordered(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges by structure, the residues of both ends, and kind."""
    end = lambda p: nodes_.select("sid", F.col("id").alias(p), F.struct("chain", "resi", F.coalesce("icode", F.lit(""))).alias(f"{p}_key"))
    keyed = edges_.join(end("source"), ["sid", "source"]).join(end("target"), ["sid", "target"])
    return keyed.orderBy("sid", "source_key", "target_key", scalars.kind_order(F.col("kind"))).select(*edges_.columns)


def node(nodes_: DataFrame, id: str) -> DataFrame:
    """That residue in each structure that has it."""
    return nodes_.where(F.col("id") == id)


def build(atoms: DataFrame, found: DataFrame, areas: DataFrame | None = None, steps: int = 300) -> dict[str, DataFrame]:
    """A network with all that is shown of it: edges, nodes (degree, betweenness, burial if there are areas, place), components, kinds, cut residues."""
    links = edges(found, atoms)
    table = nodes(links, atoms)
    if areas is not None:
        table = burial(table, areas)
    table = table.join(betweenness(links), ["sid", "id"]).join(layouts(links, steps), ["sid", "id"])
    return {"edges": links, "nodes": table, "components": components(links), "kinds": present_kinds(links), "cuts": cut_residues(links)}


def rollup(edges_: DataFrame) -> DataFrame:
    """Contacts by structure and kind with subtotals."""
    return edges_.rollup("sid", "kind").agg(F.count("*").alias("n_edges"), F.sum("count").alias("n_contacts"), F.round(F.sum("energy"), 4).alias("energy"))
