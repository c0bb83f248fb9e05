"""Solvent-accessible surface by points on spheres.

For each atom it is counted how many points of its sphere no neighbour covers,
in a kernel over one structure's atoms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import scalars
from strandex.operators import kernels, residues, roles


#: Neighbours whose points are counted together.
PAIRS = 20_000
#: Neighbours up to so many ångström are tried first.
REACH = 4.6


def sphere(n: int = C.POINTS) -> np.ndarray:
    """n points spread evenly over the unit sphere, along a golden spiral."""
    i = np.arange(n) + 0.5
    z, turn = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.column_stack((r * np.cos(turn), r * np.sin(turn), z))


def exposed(p: np.ndarray, r: np.ndarray, points: int = C.POINTS) -> np.ndarray:
    """The share of each sphere's points (centres p, radii r) that no other sphere covers.

    Near spheres cover most, so those up to REACH are tried first, and the others only against what isn't covered whole.
    """
    ball, free, before = sphere(points), np.ones(len(r)), -1.0
    hidden = np.zeros((len(r), points), bool)
    left = np.arange(len(r))
    for reach in (REACH, 2 * r.max()) if len(r) else ():
        for i, j, d2 in kernels.near(p[left], p, reach):
            i = left[i]
            keep = (i != j) & (d2 > before) & (d2 < (r[i] + r[j]) * (r[i] + r[j]))
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), PAIRS):
                a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                m, own, other = p[b] - p[a], r[a], r[b]
                # |r b - m| < R, with the squares written out
                covered = (own * own + (m * m).sum(1) - other * other)[:, None] < 2 * own[:, None] * (m @ ball.T)
                starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                hidden[a[starts]] |= np.logical_or.reduceat(covered, starts, axis=0)
        left, before = left[~hidden[left].all(1)], reach * reach
    free -= hidden.mean(1)
    return free


def _areas(s: kernels.Structure, rows: np.ndarray, probe: float, points: int) -> np.ndarray:
    elements = tuple(C.VDW)
    r = np.array([*C.VDW.values(), C.VDW_OTHER])[s.code("element", elements)[rows]] + probe  # -1 is the last
    return 4 * np.pi * r * r * exposed(s.at[rows], r, points)


def atom_areas(atoms: DataFrame, scale: float = 1.0, probe: float = C.PROBE, points: int = C.POINTS) -> DataFrame:
    """sid, atom_idx, area of the atoms given: choose them first, for all of them cover each other."""
    kernel = lambda s: {"atom_idx": s.idx, "area": _areas(s, np.arange(s.n), probe, points)}
    return kernels.per_structure(atoms, kernel, "atom_idx int, area double", scale, ("sid", "atom_idx", "element", "x", "y", "z"))


def residue_areas(atoms: DataFrame, scale: float = 1.0, selected: DataFrame | None = None) -> DataFrame:
    """sid, run, key, resn, sasa (2 places), rsa (3 places): of the polymer's heavy atoms, narrowed afterwards."""
    own = (*residues.KEY, "resn")
    table = atoms.select("sid", "atom_idx", "element", *own, "x", "y", "z", roles.bears_surface().alias("bears"))

    def kernel(s):
        rows = np.flatnonzero(pc.fill_null(s.column("bears"), False).to_numpy(zero_copy_only=False))
        return {"run": s.run[rows], **{c: s.column(c).take(pa.array(rows)) for c in own}, "atom_idx": s.idx[rows], "area": _areas(s, rows, C.PROBE, C.POINTS)}

    kind = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    found = kernels.per_structure(table, kernel, f"run long, {', '.join(f'{c} {kind[c]}' for c in own)}, atom_idx int, area double", scale, tuple(table.columns))
    if selected is not None:
        found = found.join(selected.select("sid", "atom_idx"), ["sid", "atom_idx"], "left_semi")
    total = found.groupBy("sid", "run").agg(F.min_by(F.struct(*own), "atom_idx").alias("f"), F.sum("area").alias("area")).select("sid", "run", "f.*", "area")
    return total.select("sid", "run", *residues.KEY, "resn", F.round("area", 2).alias("sasa"), F.round(scalars.relative_sasa(F.col("area"), F.col("resn")), 3).alias("rsa"))
