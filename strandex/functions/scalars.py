"""Lookups and small formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandex import constants as C


def lookup(table: dict, key: Column, other=None) -> Column:
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    return found if other is None else F.coalesce(found, F.lit(other))


def vdw_radius(element: Column) -> Column:
    return lookup(C.VDW, F.upper(element), C.VDW_OTHER)


def covalent_radius(element: Column) -> Column:
    return lookup(C.COVALENT, F.upper(element))


def max_asa(resn: Column) -> Column:
    return lookup(C.MAX_ASA, F.upper(resn))


def relative_sasa(sasa: Column, resn: Column) -> Column:
    """Not clamped; null for a residue without a largest area."""
    return sasa / max_asa(resn)


def hydropathy(resn: Column) -> Column:
    return lookup({**C.HYDROPATHY, **{k: C.HYDROPATHY[v] for k, v in C.ONE_LETTER.items()}}, F.upper(resn), 0.0)


def contact_energy(kind: Column) -> Column:
    return lookup(C.ENERGY, kind)


def kind_order(kind: Column) -> Column:
    return lookup({k: i for i, k in enumerate(C.KINDS)}, kind)


def kind_short(kind: Column) -> Column:
    """The kind's label in legends."""
    return lookup(C.SHORT, kind)


def reduce_dssp(letter: Column) -> Column:
    """DSSP's eight states to helix, sheet, coil."""
    return F.when(letter.isin("H", "G", "I"), "H").when(letter.isin("E", "B"), "E").otherwise("C")


def reduce_engine(code: Column) -> Column:
    """Turns count as coil."""
    return F.when(code.isin("H", "E"), code).otherwise("C")


def infer_element(element: Column, name: Column) -> Column:
    """The element column, else the first letter of the name."""
    given = F.upper(F.trim(element))
    return F.coalesce(F.when(given.isin("", ".", "?"), None).otherwise(given), F.nullif(F.upper(F.regexp_extract(name, "[A-Za-z]", 0)), F.lit("")))


def edge_intensity(energy: Column, most: Column) -> Column:
    return F.when(most > 0, 0.4 + 0.6 * F.log1p(energy) / F.log1p(most)).otherwise(0.4)


def hub_score(betweenness: Column, most: Column) -> Column:
    return F.when(most > 0, F.sqrt(betweenness / most)).otherwise(0.0)


def node_id(chain: Column, resi: Column, icode: Column) -> Column:
    return F.concat(chain, F.lit("/"), resi.cast("string"), F.coalesce(icode, F.lit("")))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def count_operators(expression: Column) -> Column:
    """How many transforms an operator expression makes: ranges and lists, multiplied over parenthesised groups."""
    text = F.trim(expression)
    groups = F.when(F.instr(text, "(") > 0, F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), 1)).otherwise(F.array(text))

    def term(t):
        t = F.trim(t)
        lo, hi = (F.regexp_extract(t, r"^(-?\d+)\s*-\s*(-?\d+)$", k) for k in (1, 2))
        span = F.when(lo != "", hi.try_cast("bigint") - lo.try_cast("bigint") + 1)
        return F.when(t == "", 0).when(span >= 1, span).otherwise(1).cast("bigint")

    sizes = F.transform(groups, lambda g: F.aggregate(F.transform(F.split(g, ","), term), F.lit(0).cast("bigint"), lambda a, n: a + n))
    return F.when(F.size(groups) == 0, 0).otherwise(F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, n: a * n)).cast("bigint")
