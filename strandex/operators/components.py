"""Chemistry of non-standard components, perceived from their definitions.

A component is a graph of a few dozen heavy atoms, the same wherever it occurs,
so its rules run once for each (structure, component) definition and become
tables that detectors join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Component:
    element: dict[str, str]
    aromatic: set[str]
    hydrogens: dict[str, int]
    order: list[str] = field(default_factory=list)
    bonds: dict[str, dict[str, str]] = field(default_factory=dict)

    def near(self, a: str) -> dict[str, str]:
        return self.bonds.get(a, {})

    def of(self, a: str, element: str) -> list[str]:
        return [b for b in self.near(a) if self.element.get(b) == element]

    def terminal(self, a: str, element: str) -> list[str]:
        """Neighbours of the element that have no other heavy neighbour."""
        return [b for b in self.of(a, element) if len(self.near(b)) == 1]

    def cycle(self, a: str) -> bool:
        """Whether a is in a ring: two of its neighbours are joined without it."""
        near = list(self.near(a))
        for i, s in enumerate(near):
            seen, todo = {a, s}, [s]
            while todo:
                for v in self.near(todo.pop()):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            if any(t in seen for t in near[i + 1 :]):
                return True
        return False


def hybridisation(c: Component, a: str) -> int:
    """1, 2 or 3: a triple or two double bonds; some unsaturation at or next to the atom; none."""
    orders = list(c.near(a).values())
    if "TRIP" in orders or orders.count("DOUB") >= 2:
        return 1
    if a in c.aromatic or "DOUB" in orders or "AROM" in orders or any(b in c.aromatic for b in c.near(a)):
        return 2
    if c.element.get(a) in ("C", "N", "O"):
        for b, order in c.near(a).items():
            others = [o for x, o in c.near(b).items() if x != a or order == "AROM"]
            if order in ("SING", "AROM") and any(o != "SING" for o in others):
                return 2
    return 3


def acid_oxygen(c: Component, a: str) -> bool:
    return c.element.get(a) == "O" and len(c.near(a)) == 1 and any(len(c.terminal(b, "O")) >= 2 for b in c.near(a))


def _carbonyl(c: Component, a: str) -> bool:
    return any(c.element.get(b) == "O" and o == "DOUB" for b, o in c.near(a).items())


def accepts(c: Component, a: str) -> bool:
    """Whether the atom can accept a hydrogen bond."""
    e, near = c.element.get(a), c.near(a)
    if e == "F":
        return not c.of(a, "C")
    if e == "N":
        degree, kind = len(near) + c.hydrogens.get(a, 0), hybridisation(c, a)
        return not (degree == 4 and kind == 3 or degree == 3 and kind == 2)
    if e != "O":
        return False
    if a in c.aromatic or len(near) == 2 and all(b in c.aromatic for b in near):
        return False
    if len(near) == 1:
        (b,) = near
        if c.element.get(b) == "N" and len(c.terminal(b, "O")) == 2 or c.element.get(b) == "S" and len(c.terminal(b, "O")) == 2 and not c.of(b, "N"):
            return False
    ester = len(near) == 2 and all(o == "SING" for o in near.values()) and any(c.element.get(b) == "C" and _carbonyl(c, b) for b in near)
    return not ester


def charged_sites(c: Component) -> list[tuple[int, list[str], str | None]]:
    """Sign, atoms and the centre whose linkage neutralises it (None: nothing does)."""
    out: list[tuple[int, list[str], str | None]] = []
    for a in c.order:
        e = c.element.get(a)
        if e == "C":
            nitrogens = c.of(a, "N")
            if not c.cycle(a) and (len(nitrogens) >= 3 or len(nitrogens) == 2 and hybridisation(c, a) == 2 and not _carbonyl(c, a)):
                out.append((1, nitrogens, None))
            free_o, free_s = c.terminal(a, "O"), c.terminal(a, "S")
            if len(free_o) >= 2 or len(free_o) == 1 and len(free_s) == 1:
                out.append((-1, [*free_o, *free_s], a))
        elif e == "P" and len(c.terminal(a, "O")) >= 2 or e == "S" and len(c.terminal(a, "O")) >= 3:
            out.append((-1, c.terminal(a, "O"), None))
        elif e == "N" and c.near(a) and len(c.of(a, "C")) == len(c.near(a)) and hybridisation(c, a) == 3:
            out.append((1, [a], a))
    return out


def aromatic_rings(c: Component) -> list[list[str]]:
    """Cycles of five or six aromatic atoms, each once: from the least name, toward the lesser neighbour."""
    found = []

    def walk(path: list[str]) -> None:
        for b in sorted(c.near(path[-1])):
            if b == path[0] and len(path) in (5, 6) and path[1] < path[-1]:
                if not any(x in c.near(path[i]) for i in range(len(path)) for x in path[i + 2 :] if (path[i], x) != (path[0], path[-1])):
                    found.append([*path])
            elif b in c.aromatic and b > path[0] and b not in path and len(path) < 6:
                walk([*path, b])

    for a in sorted(c.aromatic):
        walk([a])
    return found


def donor(c: Component, a: str) -> tuple[str, int, str, str | None] | None:
    """Class, hydrogens and the neighbours that orient them."""
    n = c.hydrogens.get(a, 0)
    if c.element.get(a) not in ("N", "O", "F") or n < 1 or acid_oxygen(c, a) or not c.near(a):
        return None
    near = list(c.near(a))
    if len(near) == 1:
        second = next((b for b in c.near(near[0]) if b != a), None)
        if hybridisation(c, a) == 3 or second is None or n > 2:
            return "rotor", n, near[0], second
        return "planar", n, near[0], second
    if len(near) == 2 and n == 2:
        return "straddling", 2, near[0], near[1]
    return "outward", 1, near[0], near[1]


def _components(pdf_atoms: pd.DataFrame, pdf_bonds: pd.DataFrame) -> Component:
    pdf_atoms = pdf_atoms.sort_values("ord")
    c = Component(dict(zip(pdf_atoms["atom_name"], pdf_atoms["element"], strict=True)), set(pdf_atoms.loc[pdf_atoms["aromatic"].astype(bool), "atom_name"]), dict(zip(pdf_atoms["atom_name"], pdf_atoms["h_count"].astype(int), strict=True)), list(dict.fromkeys(pdf_atoms["atom_name"])))
    for a, b, o in zip(pdf_bonds["a"], pdf_bonds["b"], pdf_bonds["bond_order"], strict=True):
        c.bonds.setdefault(a, {})[b] = o
        c.bonds.setdefault(b, {})[a] = o
    return c


_PERCEIVED = "sid {0}, comp_id string, what string, number int, sign int, ord int, size int, atom_name string, centre string, accepts boolean, n_bonds int, hybridisation int, class string, count int, first string, second string"


def perceive(comp_atoms: DataFrame, comp_bonds: DataFrame) -> dict[str, DataFrame]:
    """roles, sites, rings and hydrogens of every component, and its bonds."""
    kind = comp_atoms.schema["sid"].dataType.simpleString()

    def run(atoms: pd.DataFrame, bonds: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in _PERCEIVED.split(", ")]
        if not len(atoms):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        sid, comp = atoms["sid"].iloc[0], atoms["comp_id"].iloc[0]
        c = _components(atoms, bonds)
        rows = []
        add = lambda **x: rows.append({"sid": sid, "comp_id": comp, **x})
        for a in c.order:
            add(what="role", atom_name=a, accepts=accepts(c, a), n_bonds=len(c.near(a)), hybridisation=hybridisation(c, a))
            if found := donor(c, a):
                add(what="donor", atom_name=a, **dict(zip(("class", "count", "first", "second"), found, strict=True)))
        for k, (sign, members, centre) in enumerate(charged_sites(c)):
            for a in members:
                add(what="site", number=k, sign=sign, atom_name=a, centre=centre)
        for k, ring in enumerate(aromatic_rings(c)):
            for i, a in enumerate(ring):
                add(what="ring", number=k, ord=i, size=len(ring), atom_name=a)
        return pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    keys = ["sid", "comp_id"]
    comp_bonds = comp_bonds.select(*(F.col(c).alias(c) for c in comp_bonds.columns))  # both may come from one table of rows
    found = comp_atoms.groupBy(*keys).cogroup(comp_bonds.groupBy(*keys)).applyInPandas(run, _PERCEIVED.format(kind))
    of = lambda what: found.where(F.col("what") == what)
    return {
        "bonds": comp_bonds, "roles": of("role").select(*keys, "atom_name", "accepts", "n_bonds", "hybridisation"),
        "sites": of("site").select(*keys, F.col("number").alias("site"), "sign", "atom_name", "centre"),
        "rings": of("ring").select(*keys, F.col("number").alias("ring"), "ord", "size", "atom_name"),
        "hydrogens": of("donor").select(*keys, "atom_name", "class", "count", "first", "second"),
    }
