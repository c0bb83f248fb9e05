"""Kernels over the atoms of one structure, in numpy.

What is looked up within a structure (residues, neighbours, bonds, contacts)
would be a shuffle of all atoms for each join, and 27 copies of them for each
radius join.  Here the atoms are dealt out by structure once and a kernel does
the rest in its task; pairs are made a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex import constants as C

#: Candidate pairs whose distances are measured at once.
SLICE = 1_000_000
#: What the kernels read of atoms.
COLUMNS = ("sid", "atom_idx", "name", "resn", "element", "chain", "resi", "icode", "altloc", "x", "y", "z")


def sid_type(df: DataFrame) -> str:
    return df.schema["sid"].dataType.simpleString()


def per_structure(atoms: DataFrame, kernel, schema: str, scale: float = 1.0, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """kernel(Structure) gives the columns but sid, as a dict; schema names them after ``sid``."""
    whole = f"sid {sid_type(atoms)}, {schema}"
    names = [x.split()[0] for x in whole.split(", ")]
    types = _arrow(atoms.sparkSession, whole)

    def run(table: pa.Table) -> pa.Table:
        return _table(table.column("sid")[0], kernel(Structure(table, scale)), names, types)

    return atoms.select(*columns).groupBy("sid").applyInArrow(run, whole)


def with_atoms(rows: DataFrame, atoms: DataFrame, kernel, schema: str, columns: tuple[str, ...]) -> DataFrame:
    """kernel(rows, atoms) of one structure's tables gives the columns but sid, as a dict; structures without rows are left out."""
    whole = f"sid {sid_type(rows)}, {schema}"
    names = [x.split()[0] for x in whole.split(", ")]
    types = _arrow(atoms.sparkSession, whole)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        return _table(left.column("sid")[0], kernel(left, right), names, types)

    return rows.groupBy("sid").cogroup(atoms.select(*columns).groupBy("sid")).applyInArrow(run, whole)


def _arrow(spark, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]


def _table(sid: pa.Scalar, found: dict, names: list[str], types: list[pa.DataType]) -> pa.Table:
    n = len(next(iter(found.values())))
    columns = [pa.repeat(sid, n), *(found[x] for x in names[1:])]
    return pa.table([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c if isinstance(c, pa.Array) else pa.array(c)).cast(t) for c, t in zip(columns, types, strict=True)], names=names)


def _cells(p: np.ndarray, size: float, low: np.ndarray) -> np.ndarray:
    return np.floor((p - low) / size).astype(np.int64) + 1


def near(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, d2 of the rows of a and b (positions, n x 3) at most ``reach`` apart, in slices; ordered by i, d2 in their own unit."""
    if not len(a) or not len(b):
        return
    low = np.minimum(a.min(0), b.min(0))
    ca, cb = _cells(a, reach, low), _cells(b, reach, low)
    wide = np.maximum(ca.max(0), cb.max(0)) + 2
    key = lambda c: (c[:, 0] * wide[1] + c[:, 1]) * wide[2] + c[:, 2]
    kb = key(cb)
    order = np.argsort(kb, kind="stable")
    kb, b = kb[order], b[order]
    # cells along z follow each other, so a row of three is one range
    rows = np.array([(i * wide[1] + j) * wide[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    middle = key(ca)[:, None] + rows
    first, last = np.searchsorted(kb, middle - 1, "left"), np.searchsorted(kb, middle + 1, "right")
    size = (last - first).sum(1)
    done, lo = np.cumsum(size), 0
    limit = reach * reach
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - size[lo] + SLICE, "right")))
        start, count = first[lo:hi].ravel(), (last - first)[lo:hi].ravel()
        j = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        i = np.repeat(np.arange(lo, hi), size[lo:hi])
        d = a[i] - b[j]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        keep = np.flatnonzero(d2 <= limit)
        yield i[keep], order[j[keep]], d2[keep]
        lo = hi


def near_all(a: np.ndarray, b: np.ndarray, reach: float, keep=lambda i, j, d2: None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``near``, or what ``keep`` (a mask) holds of it, which is applied slice by slice."""
    parts = []
    for i, j, d2 in near(a, b, reach):
        mask = keep(i, j, d2)
        parts.append((i, j, d2) if mask is None else (i[mask], j[mask], d2[mask]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, a.dtype)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def first_rows(*columns: np.ndarray, by: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """For each distinct row of ``columns`` the place that is least in ``by``, in the order of the columns."""
    order = np.lexsort((*by[::-1], *columns[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order[new]


class Structure:
    """The atoms of one structure by atom_idx; strings as codes."""

    def __init__(self, table: pa.Table, scale: float = 1.0):
        table = table.take(pc.sort_indices(table, [("atom_idx", "ascending")])).combine_chunks()
        self.table, self.scale, self.n = table, scale, table.num_rows
        self.idx = table.column("atom_idx").to_numpy()
        self.xyz = np.column_stack([table.column(c).to_numpy() for c in "xyz"]) if "x" in table.column_names else None

    def column(self, name: str) -> pa.Array:
        c = self.table.column(name)
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    @cached_property
    def element(self) -> pa.Array:
        return pc.utf8_upper(self.column("element"))

    def code(self, name: str, values: tuple[str, ...]) -> np.ndarray:
        """The place in values, or -1."""
        column = self.element if name == "element" else self.column(name)
        return pc.fill_null(pc.index_in(column, pa.array(values, column.type)), -1).to_numpy(zero_copy_only=False)

    def isin(self, name: str, values: tuple[str, ...]) -> np.ndarray:
        return self.code(name, values) >= 0

    @cached_property
    def key(self) -> np.ndarray:
        """chain, resi, icode as integers that are equal where they are."""
        same = lambda c: pc.fill_null(pc.dictionary_encode(self.column(c)).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.column_stack((same("chain"), self.column("resi").to_numpy(zero_copy_only=False).astype(np.int64), same("icode")))

    @cached_property
    def run(self) -> np.ndarray:
        new = np.zeros(self.n, np.int64)
        new[1:] = (self.key[1:] != self.key[:-1]).any(1)
        return np.cumsum(new)

    @cached_property
    def residue(self) -> np.ndarray:
        """A number for each distinct key."""
        order = np.lexsort(self.key.T[::-1])
        out = np.zeros(self.n, np.int64)
        out[order[1:]] = np.cumsum((self.key[order[1:]] != self.key[order[:-1]]).any(1))
        return out

    def places(self, atom_idx: np.ndarray) -> np.ndarray:
        """The rows of those atoms, or -1."""
        at = np.searchsorted(self.idx, atom_idx)
        return np.where((at < self.n) & (self.idx[np.minimum(at, self.n - 1)] == atom_idx), at, -1)

    @cached_property
    def rank(self) -> np.ndarray:
        """The place of each atom's residue in the order of chain, number, insertion code (none first)."""
        def ordered(c):
            codes = pc.dictionary_encode(self.column(c))
            by = np.argsort(np.argsort([x.encode() for x in codes.dictionary.to_pylist()])) if len(codes.dictionary) else np.zeros(0, np.int64)
            at = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
            return np.append(by, -1)[at].astype(np.int64)  # the last stands for none

        keys = (ordered("chain"), self.key[:, 1], ordered("icode"))
        order = np.lexsort(keys[::-1])
        out = np.zeros(self.n, np.int64)
        out[order[1:]] = np.cumsum(np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0))
        return out

    @cached_property
    def node(self) -> pa.Array:
        """The node id of each atom's residue."""
        number = pc.binary_join_element_wise(self.column("chain"), self.column("resi").cast(pa.string()), "/")
        return pc.binary_join_element_wise(number, pc.fill_null(self.column("icode"), ""), "")

    @cached_property
    def name(self) -> np.ndarray:
        return self.code("name", NAMES).astype(np.int64)

    @cached_property
    def resn(self) -> np.ndarray:
        return self.code("resn", C.AMINO).astype(np.int64)

    @cached_property
    def altloc(self) -> np.ndarray:
        return pc.fill_null(pc.dictionary_encode(self.column("altloc")).indices, -1).to_numpy(zero_copy_only=False)

    @cached_property
    def water(self) -> np.ndarray:
        return self.isin("resn", C.WATER)

    @cached_property
    def metal(self) -> np.ndarray:
        return self.isin("element", C.METALS)

    @cached_property
    def at(self) -> np.ndarray:
        """Positions in ångström."""
        return self.xyz / float(self.scale)

    def square(self, v: float):
        """A distance in ångström, squared, in the unit of the coordinates."""
        return int(round(v * self.scale)) ** 2 if self.scale != 1 else v * v

    def reach(self, v: float):
        return int(round(v * self.scale)) if self.scale != 1 else v

    def gate(self, d2: np.ndarray, lo: float, hi: float) -> np.ndarray:
        return (d2 > self.square(lo)) & (d2 < self.square(hi))

    def angstrom(self, d2: np.ndarray) -> np.ndarray:
        return np.sqrt(d2.astype(float)) / float(self.scale)

    @cached_property
    def _named(self) -> tuple[np.ndarray, np.ndarray]:
        """Known atoms by run, name and place: the sorted keys and the places."""
        known = np.flatnonzero(self.name >= 0)
        keys = self.run[known] * len(NAMES) + self.name[known]
        order = np.argsort(keys, kind="stable")
        return keys[order], known[order]

    def mates(self, rows: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and, for each, the atoms of its run with that name (code), in order."""
        keys, places = self._named
        want = self.run[rows] * len(NAMES) + name
        lo, hi = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        size = np.where(name >= 0, hi - lo, 0)
        return np.repeat(np.arange(len(rows)), size), places[np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)]

    def last_named(self, name: str) -> np.ndarray:
        """For each run its last atom of the name, or -1."""
        out = np.full(self.run[-1] + 1 if self.n else 0, -1)
        rows = np.flatnonzero(self.name == NAME[name])
        out[self.run[rows]] = rows  # later rows win
        return out

    @cached_property
    def bonds(self) -> np.ndarray:
        """Rows a, b of every bond, both ways, each once, by a and b."""
        return bonds(self)

    def bonded(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each atom how many neighbours are wanted (a mask), and the last of them."""
        a, b = self.bonds[wanted[self.bonds[:, 1]]].T
        last = np.full(self.n, -1)
        last[a] = b
        return np.bincount(a, minlength=self.n), last


def _names() -> tuple[str, ...]:
    found = [*C.BACKBONE, "OXT", *(x for r in C.side_chain_bonds() for x in r[1:]), *(n for _, names in C.CHARGED.values() for n in names), *(n for rings in C.RINGS.values() for ring in rings for n in ring), *(n for names in C.METAL_DONORS.values() for n in names), *(n for _, n in C.DONORS)]
    return tuple(dict.fromkeys(found))


#: Names that the chemistry of the standard residues knows.
NAMES = _names()
NAME = {n: i for i, n in enumerate(NAMES)}
RESN = {r: i for i, r in enumerate(C.AMINO)}


@cache
def _topology() -> np.ndarray:
    """For each residue and name the names bonded to it, filled up with -1."""
    out = np.full((len(RESN), len(NAMES), 6), -1)
    used = np.zeros((len(RESN), len(NAMES)), int)
    for r, a, b in C.side_chain_bonds():
        for x, y in ((a, b), (b, a)):
            at = RESN[r], NAME[x]
            if NAME[y] not in out[at]:
                out[(*at, used[at])] = NAME[y]
                used[at] += 1
    return out


def bonds(s: Structure) -> np.ndarray:
    """The bonds of the standard residues, of peptides, and by distance between residues."""
    pairs = []
    known = np.flatnonzero((s.resn >= 0) & (s.name >= 0))
    partners = _topology()[s.resn[known], s.name[known]]
    keys, places = s._named
    for k in range(partners.shape[1]):  # of a repeated name the last atom is meant
        some = np.flatnonzero(partners[:, k] >= 0)
        want = s.run[known[some]] * len(NAMES) + partners[some, k]
        last = np.searchsorted(keys, want, "right") - 1
        hit = (last >= 0) & (keys[last] == want) if len(keys) else np.zeros(len(some), bool)
        a, b = known[some][hit], places[last[hit]]
        pairs.append(np.column_stack((a, b))[a < b])
    n, c = s.last_named("N"), s.last_named("C")
    before = _last_before(c)
    runs = np.flatnonzero((n >= 0) & (before >= 0))
    a, b = before[runs], n[runs]
    d = s.xyz[a] - s.xyz[b]
    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
    linked = (s.key[a, 0] == s.key[b, 0]) & (d2 <= (C.PEPTIDE * s.scale) ** 2)
    pairs.append(np.column_stack((a, b))[linked])
    radii = tuple(C.COVALENT)
    element = s.code("element", radii)
    heavy = np.flatnonzero((element >= 0) & ~s.water & ~s.metal)
    radius = np.array([C.COVALENT[e] for e in radii])[element[heavy]]

    def close(i, j, d2):
        limit = (radius[i] + radius[j] + C.COVALENT_SLACK) * s.scale
        return (i < j) & (s.residue[heavy[i]] != s.residue[heavy[j]]) & (d2 < limit * limit)

    i, j, _ = near_all(s.xyz[heavy], s.xyz[heavy], s.reach(C.COVALENT_REACH), close)
    pairs.append(np.column_stack((heavy[i], heavy[j])))
    one = np.concatenate(pairs)
    both = np.unique(np.concatenate((one[:, 0] * s.n + one[:, 1], one[:, 1] * s.n + one[:, 0]))) if len(one) else np.zeros(0, np.int64)
    return np.column_stack((both // max(1, s.n), both % max(1, s.n)))


def _last_before(x: np.ndarray) -> np.ndarray:
    """For each run the value of the last earlier run that has one, or -1."""
    at = np.maximum.accumulate(np.where(x >= 0, np.arange(len(x)), -1)) if len(x) else x
    at = np.concatenate(([-1], at[:-1])) if len(x) else at
    return np.where(at >= 0, x[at], -1)


# vectors: rows of n x 3 ----------------------------------------------------

def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def unit(a: np.ndarray) -> np.ndarray:
    """NaN for a vector without a direction."""
    n = np.sqrt(dot(a, a))
    with np.errstate(invalid="ignore", divide="ignore"):
        return a * np.where(n > 1e-6, 1 / n, np.nan)[:, None]


def angle_at(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = a - v, b - v
    n = np.sqrt(dot(p, p)) * np.sqrt(dot(q, q))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1e-12, np.degrees(np.arccos(np.clip(dot(p, q) / n, -1, 1))), np.where(np.isnan(n), np.nan, 0.0))


def rotor_toward(d: np.ndarray, antecedent: np.ndarray, target: np.ndarray) -> np.ndarray:
    along, radius = -np.cos(np.radians(C.SP3)), np.sin(np.radians(C.SP3))
    axis, to = unit(d - antecedent), target - d
    off = unit(to - axis * dot(to, axis)[:, None])
    other = np.where((np.abs(axis[:, 0]) < 0.9)[:, None], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])
    off = np.where(np.isnan(off), unit(np.cross(axis, other)), off)
    return d + (axis * along + off * radius) * C.BOND_H


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack((a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]))


# hydrogens -----------------------------------------------------------------

def _neighbours_of_donors() -> np.ndarray:
    """For each residue and name: class (place in _CLASSES, -1: no donor), hydrogens, first and second neighbour."""
    bonded: dict[tuple[str, str], list[str]] = {}
    for r, a, b in C.side_chain_bonds():
        bonded.setdefault((r, a), []).append(b)
        bonded.setdefault((r, b), []).append(a)
    out = np.full((len(RESN), len(NAMES), 4), -1)
    for (r, n), (kind, count) in C.DONORS.items():
        first = bonded[r, n][0]
        second = bonded[r, n][1] if kind == "bisector" else next(x for x in bonded[r, first] if x != n)
        out[RESN[r], NAME[n]] = _CLASSES.index(kind), count, NAME[first], NAME[second]
    return out


_CLASSES = ("rotor", "planar", "bisector")
_DONORS = _neighbours_of_donors()


def _mate(s: Structure, rows: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each row the atom of that name in its run: of its own conformer, else of none, else any; or -1."""
    at, found = s.mates(rows, name)
    rank = np.where(s.altloc[found] == s.altloc[rows[at]], 0, np.where(s.altloc[found] < 0, 1, 2))
    best = first_rows(at, by=(rank, found))
    out = np.full(len(rows), -1)
    out[at[best]] = found[best]
    return out


def donors(s: Structure) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the donors, fixed hydrogens (n x 2 x 3, NaN where there is none), antecedents of rotors (NaN for others), hydrogens."""
    known = np.flatnonzero((s.resn >= 0) & (s.name >= 0))
    table = _DONORS[s.resn[known], s.name[known]]
    side, table = known[table[:, 0] >= 0], table[table[:, 0] >= 0]
    one, two = _mate(s, side, table[:, 2]), _mate(s, side, table[:, 3])
    has = one >= 0
    side, table, one, two = side[has], table[has], one[has], two[has]
    p, q1 = s.at[side], s.at[one]
    q2 = np.where((two >= 0)[:, None], s.at[two], np.nan)
    kind = table[:, 0][:, None]
    fixed = np.full((len(side), 2, 3), np.nan)
    half = np.radians(C.SP2 / 2)
    away = unit(p - q1)
    aside = cross(unit(cross(p - q1, q2 - q1)), away)
    middle = p + away * np.cos(half)
    with np.errstate(invalid="ignore"):
        fixed[:, 0] = np.where(kind == 1, middle + aside * np.sin(half), p - unit(np.nan_to_num(unit(q1 - p)) + np.nan_to_num(unit(q2 - p))) * C.BOND_H)
        fixed[:, 1] = np.where(kind == 1, middle - aside * np.sin(half), np.nan)
    fixed[(kind[:, 0] == 0) | (two < 0)] = np.nan
    antecedent = np.where(kind == 0, q1, np.nan)
    # backbone nitrogens: opposite the last carbonyl of the chain, or three on a chain's first residue
    c, o, ca = s.last_named("C"), s.last_named("O"), s.last_named("CA")
    n = np.flatnonzero((s.name == NAME["N"]) & (s.resn >= 0) & (s.resn != RESN["PRO"]))
    before = np.arange(len(c))
    before = _last_before(np.where(c >= 0, before, -1))[s.run[n]]
    at = np.maximum(before, 0)
    inside = (before >= 0) & (s.key[c[at], 0] == s.key[n, 0])
    d = s.at[c[at]] - s.at[n]
    held = inside & (np.sqrt(dot(d, d)) <= C.PEPTIDE) & (o[at] >= 0)
    h = np.full((len(n), 2, 3), np.nan)
    h[:, 0] = np.where(held[:, None], s.at[n] + unit(s.at[c[at]] - s.at[o[at]]) * C.BOND_H, np.nan)
    first = np.where((~inside & (ca[s.run[n]] >= 0))[:, None], s.at[ca[s.run[n]]], np.nan)
    rows = np.concatenate((side, n))
    fixed, antecedent, count = np.concatenate((fixed, h)), np.concatenate((antecedent, first)), np.concatenate((table[:, 1], np.where(inside, 1, 3)))
    keep = ~np.isnan(fixed[:, 0, 0]) | ~np.isnan(antecedent[:, 0])
    return rows[keep], fixed[keep], antecedent[keep], count[keep]


def acceptors(s: Structure) -> np.ndarray:
    return np.flatnonzero((s.resn >= 0) & (s.isin("element", ("O",)) | (s.resn == RESN["HIS"]) & ((s.name == NAME["ND1"]) | (s.name == NAME["NE2"]))))


def _hydrogens(s: Structure, found, k: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The hydrogens (n x 2 x 3) of donors k, a rotor's turned toward the target (then the first stands for all)."""
    rows, fixed, antecedent, _ = found
    turned = np.isnan(fixed[k, 0, 0])
    out = fixed[k]
    out[turned, 0] = rotor_toward(s.at[rows[k[turned]]], antecedent[k[turned]], target[turned])
    return out


# contacts ------------------------------------------------------------------

def _hydrogen_bonds(s: Structure):
    found = donors(s)
    rows, fixed, _, count = found
    taken = acceptors(s)
    i, j, d2 = near_all(s.xyz[rows], s.xyz[taken], s.reach(C.HBOND), lambda i, j, d2: (s.residue[rows[i]] != s.residue[taken[j]]) & s.gate(d2, C.LEAST, C.HBOND))
    target = s.at[taken[j]]
    h = _hydrogens(s, found, i, target)
    angles = np.column_stack([angle_at(h[:, k], s.at[rows[i]], target) for k in (0, 1)])
    turned = np.isnan(fixed[i, 0, 0])
    candidates: dict[int, list] = {}
    with np.errstate(invalid="ignore"):
        good = np.flatnonzero((angles > C.HBOND_ANGLE).any(1))
    for p in good.tolist():
        own = range(count[i[p]]) if turned[p] else [k for k in (0, 1) if angles[p, k] > C.HBOND_ANGLE]
        candidates.setdefault(i[p], []).extend((-angles[p, 0 if turned[p] else k], int(taken[j[p]]), k, p) for k in own)
    chosen = []
    for all_ in candidates.values():  # the straightest first: no hydrogen and no acceptor twice
        spent, used = set(), set()
        for angle, b, k, p in sorted(all_):
            if k not in spent and b not in used:
                spent.add(k)
                used.add(b)
                chosen.append((p, -angle))
    p = np.array([x for x, _ in chosen], np.int64)
    return _plain(s, rows[i[p]], taken[j[p]], d2[p], angle=np.array([x for _, x in chosen], float))


def _water_bridges(s: Structure):
    found = donors(s)
    rows, taken = found[0], acceptors(s)
    water = np.flatnonzero(s.water & s.isin("element", ("O",)))
    lo, hi = C.WATER_LEGS
    band = lambda i, j, d2: d2 >= s.square(lo)
    i, w, first = near_all(s.xyz[rows], s.xyz[water], s.reach(hi), band)
    target = s.at[water[w]]
    h = _hydrogens(s, found, i, target)
    angles = np.column_stack([angle_at(h[:, k], s.at[rows[i]], target) for k in (0, 1)])
    angles = np.where(np.isnan(angles), -1.0, angles)
    # the larger angle; of equal ones the larger place
    later = (angles[:, 1] > angles[:, 0]) | (angles[:, 1] == angles[:, 0]) & (angles[:, 1] >= 0) & np.array([tuple(y) > tuple(x) for x, y in h], bool).reshape(len(h))
    best, h = np.where(later, angles[:, 1], angles[:, 0]), np.where(later[:, None], h[:, 1], h[:, 0])
    keep = best > C.WATER_THETA
    i, w, first, h = i[keep], w[keep], first[keep], h[keep]
    v, j, second = near_all(s.xyz[water], s.xyz[taken], s.reach(hi), band)
    lo, size = np.searchsorted(v, w, "left"), np.searchsorted(v, w, "right") - np.searchsorted(v, w, "left")
    x = np.repeat(np.arange(len(w)), size)
    y = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
    a, b = rows[i[x]], taken[j[y]]
    omega = angle_at(s.at[water[w[x]]], s.at[b], h[x])
    ok = (s.residue[a] != s.residue[b]) & (omega > C.WATER_OMEGA[0]) & (omega < C.WATER_OMEGA[1])
    return _plain(s, a[ok], b[ok], np.maximum(first[x], second[y])[ok], angle=omega[ok], bridge=s.idx[water[w[x]]][ok])


def _charged_groups(s: Structure):
    """Sign, atoms (rows), centre and first atom of each group."""
    sign = np.zeros((len(RESN), len(NAMES)), np.int64)
    for r, (v, names) in C.CHARGED.items():
        for n in names:
            sign[RESN[r], NAME[n]] = v
    known = np.flatnonzero((s.resn >= 0) & (s.name >= 0))
    value = sign[s.resn[known], s.name[known]]
    rows, value = known[value != 0], value[value != 0]
    order = np.lexsort((rows, value, s.run[rows]))
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), bool)
    new[1:] = (value[1:] != value[:-1]) | (s.run[rows[1:]] != s.run[rows[:-1]])
    starts = np.flatnonzero(new)
    members = np.split(rows, starts[1:]) if len(rows) else []
    total = np.add.reduceat(s.xyz[rows], starts, axis=0) if len(rows) else np.zeros((0, 3))
    return value[starts], members, total / np.array([len(m) for m in members], float)[:, None], rows[starts]


def _salt_bridges(s: Structure):
    sign, members, centre, first = _charged_groups(s)
    plus, minus = np.flatnonzero(sign > 0), np.flatnonzero(sign < 0)
    i, j, d2 = near_all(centre[plus], centre[minus], s.reach(C.SALT), lambda i, j, d2: (s.residue[first[plus[i]]] != s.residue[first[minus[j]]]) & s.gate(d2, C.LEAST, C.SALT))
    return _lists(s, [members[x] for x in plus[i]], [members[x] for x in minus[j]], d2)


def _rings(s: Structure):
    """Members (rows in ring order), run, number, centre and normal of the whole rings with a normal."""
    head = s.resn[np.searchsorted(s.run, s.run, "left")] if s.n else s.resn  # the residue is what the run's first atom says
    out = []
    for r, found in C.RINGS.items():
        heads = np.flatnonzero((head == RESN[r]) & (np.concatenate(([True], s.run[1:] != s.run[:-1])) if s.n else False))
        for k, names in enumerate(found):
            rows = np.full((len(heads), len(names)), -1)
            for i, n in enumerate(names):
                at, mates = s.mates(heads, np.full(len(heads), NAME[n]))
                rows[at[::-1], i] = mates[::-1]  # of a repeated name the first atom counts
            for row in rows[(rows >= 0).all(1)]:
                p, q = s.at[row], np.roll(s.at[row], -1, axis=0)
                normal = unit(np.array([[((p[:, u] - q[:, u]) * (p[:, v] + q[:, v])).sum() for u, v in ((1, 2), (2, 0), (0, 1))]]))[0]
                if not np.isnan(normal[0]):
                    out.append((row, s.run[row[0]], k, s.xyz[row].sum(0) / len(row), normal))
    out.sort(key=lambda x: x[1:3])
    return out


def _offset(q: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    d = q - c
    d = d - n * dot(d, n)[:, None]
    return np.sqrt(dot(d, d))


def _pi_stacking(s: Structure):
    rings = _rings(s)
    if not rings:
        return None
    centre, normal = np.array([x[3] for x in rings], float), np.array([x[4] for x in rings])
    of = s.residue[np.array([x[0][0] for x in rings])]
    i, j, d2 = near_all(centre, centre, s.reach(C.PI_STACK), lambda i, j, d2: (i < j) & (of[i] != of[j]) & s.gate(d2, C.LEAST, C.PI_STACK))
    p = centre / float(s.scale)
    angle = np.degrees(np.arccos(np.clip(dot(normal[i], normal[j]), -1, 1)))
    angle = np.minimum(angle, 180 - angle)
    ok = (np.minimum(_offset(p[j], p[i], normal[i]), _offset(p[i], p[j], normal[j])) < C.OFFSET) & ((angle < C.PLANE_ANGLE) | (angle > 90 - C.PLANE_ANGLE))
    return _lists(s, [rings[x][0] for x in i[ok]], [rings[x][0] for x in j[ok]], d2[ok], angle[ok])


def _pi_cation(s: Structure):
    rings = _rings(s)
    if not rings:
        return None
    sign, members, at, first = _charged_groups(s)
    plus = np.flatnonzero(sign > 0)
    centre, normal = np.array([x[3] for x in rings], float), np.array([x[4] for x in rings])
    of = s.residue[np.array([x[0][0] for x in rings])]
    i, j, d2 = near_all(centre, at[plus], s.reach(C.PI_CATION), lambda i, j, d2: (of[i] != s.residue[first[plus[j]]]) & s.gate(d2, C.LEAST, C.PI_CATION))
    ok = _offset(at[plus[j]] / float(s.scale), centre[i] / float(s.scale), normal[i]) < C.OFFSET
    return _lists(s, [rings[x][0] for x in i[ok]], [members[x] for x in plus[j[ok]]], d2[ok])


def _hydrophobic(s: Structure):
    carbon = s.isin("element", ("C",))
    other = carbon | pc.is_null(s.element).to_numpy(zero_copy_only=False)
    apolar = np.flatnonzero(carbon & (s.bonded(carbon)[0] > 0) & (s.bonded(~other)[0] == 0))
    of = s.residue[apolar]
    i, j, d2 = near_all(s.xyz[apolar], s.xyz[apolar], s.reach(C.HYDROPHOBIC), lambda i, j, d2: (i < j) & (of[i] != of[j]) & s.gate(d2, C.LEAST, C.HYDROPHOBIC))
    # for each atom and residue on the other side the shortest contact, then the same the other way round
    once = first_rows(i, of[j], by=(d2, j))
    i, j, d2 = i[once], j[once], d2[once]
    twice = first_rows(j, of[i], by=(d2, i))
    return _plain(s, apolar[i[twice]], apolar[j[twice]], d2[twice])


def _halogen_bonds(s: Structure, elements: tuple[str, ...]):
    def sole(which, of):
        count, last = s.bonded(s.isin("element", of))
        rows = np.flatnonzero(s.isin("element", which) & (count == 1))
        return rows, s.at[last[rows]]

    (a, an), (h, hn) = sole(C.HALOGEN_ACCEPTORS, C.ANTECEDENTS), sole(elements, ("C",))
    i, j, d2 = near_all(s.xyz[a], s.xyz[h], s.reach(C.HALOGEN), lambda i, j, d2: (s.residue[a[i]] != s.residue[h[j]]) & s.gate(d2, C.LEAST, C.HALOGEN))
    at_acceptor, at_halogen = angle_at(s.at[a[i]], an[i], s.at[h[j]]), angle_at(s.at[h[j]], s.at[a[i]], hn[j])
    near_ = lambda x, v: (x > v - C.HALOGEN_SLACK) & (x < v + C.HALOGEN_SLACK)
    ok = near_(at_acceptor, C.HALOGEN_ACCEPTOR) & near_(at_halogen, C.HALOGEN_DONOR)
    return _plain(s, h[j[ok]], a[i[ok]], d2[ok], angle=at_halogen[ok])


def _metal_coordination(s: Structure):
    side = np.zeros((len(RESN) + 1, len(NAMES) + 1), bool)
    for r, names in C.METAL_DONORS.items():
        side[RESN[r], [NAME[n] for n in names]] = True
    a = np.flatnonzero(s.water & s.isin("element", ("O",)) | (s.name == NAME["O"]) | (s.name == NAME["OXT"]) | side[s.resn, s.name])
    m = np.flatnonzero(s.metal)
    i, j, d2 = near_all(s.xyz[m], s.xyz[a], s.reach(C.METAL), lambda i, j, d2: s.gate(d2, C.LEAST, C.METAL))
    return _plain(s, m[i], a[j], d2)


def _disulfides(s: Structure):
    a = np.flatnonzero((s.resn == RESN["CYS"]) & (s.name == NAME["SG"]))
    i, j, d2 = near_all(s.xyz[a], s.xyz[a], s.reach(C.DISULFIDE), lambda i, j, d2: (i < j) & (d2 > (C.LEAST * s.scale) ** 2))
    return _plain(s, a[i], a[j], d2)


def _plain(s: Structure, a: np.ndarray, b: np.ndarray, d2: np.ndarray, angle: np.ndarray | None = None, bridge: np.ndarray | None = None):
    """Contacts of single atoms."""
    ones = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1), pa.int32()), pa.array(s.idx[x], pa.int32()))
    return _contacts(s, ones(a), ones(b), d2, angle, bridge)


def _lists(s: Structure, a: list, b: list, d2: np.ndarray, angle: np.ndarray | None = None):
    """Contacts of groups of atoms."""
    of = lambda x: pa.array([s.idx[m].tolist() for m in x], pa.list_(pa.int32()))
    return _contacts(s, of(a), of(b), d2, angle, None)


def _contacts(s: Structure, a: pa.Array, b: pa.Array, d2: np.ndarray, angle: np.ndarray | None, bridge: np.ndarray | None):
    n = len(d2)
    return {
        "atoms_a": a, "atoms_b": b, "distance": pa.array(s.angstrom(d2)),
        "angle": pa.nulls(n, pa.float64()) if angle is None else pa.array(angle), "bridge": pa.nulls(n, pa.int32()) if bridge is None else pa.array(bridge, pa.int32()),
    }


def contacts(s: Structure, kinds: tuple[str, ...], halogens: tuple[str, ...]) -> dict:
    """The kinds of contacts asked for, one after the other."""
    makers = {
        "hydrogen-bond": _hydrogen_bonds, "salt-bridge": _salt_bridges, "hydrophobic": _hydrophobic, "pi-stacking": _pi_stacking, "pi-cation": _pi_cation,
        "halogen-bond": lambda s: _halogen_bonds(s, halogens), "water-bridge": _water_bridges, "metal-coordination": _metal_coordination, "disulfide": _disulfides,
    }
    found = [(k, x) for k in C.KINDS if k in kinds and (x := makers[k](s)) is not None]
    if not found:
        return {"kind": pa.array([], pa.string()), **_plain(s, *[np.zeros(0, np.int64)] * 3)}
    joined = {c: pa.concat_arrays([x[c] for _, x in found]) for c in found[0][1]}
    return {"kind": pa.concat_arrays([pa.repeat(pa.scalar(k), len(x["distance"])) for k, x in found]), **joined}
