"""The registered structure queries over the pseudo-atoms, each with independent SQL.

The SQL is naive on purpose (all pairs, nested subqueries): it checks the
operators, it doesn't share their plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex import constants as C
from strandex.functions import scalars
from strandex.operators import bonds, dssp, hydrogens, interactions, network, residues, roles, sasa, spatial, validation
from strandex.plans import selection
from strandex.sources import pseudo

S = pseudo.SCALE
_WITH = "with " + pseudo.SQL
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(pseudo.atoms(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table_query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")


def _other_residue(a: str, b: str) -> str:
    return f"not ({a}.chain = {b}.chain and {a}.resi = {b}.resi and {a}.icode is not distinct from {b}.icode)"


# scans, runs, conformers ---------------------------------------------------

@_query("scan_atoms", _WITH + " select * from atoms")
def scan_atoms(a: DataFrame) -> DataFrame:
    return a.drop("element")


_RUNS = """runs as (select *, sum(fresh) over (partition by sid order by atom_idx) - 1 as run from (
  select *, case when lag(resi) over w = resi and lag(chain) over w = chain and lag(icode) over w is not distinct from icode then 0 else 1 end as fresh from el window w as (partition by sid order by atom_idx)))"""


@_query("residue_runs", f"{_WITH}, {_RUNS} select sid, cast(run as bigint) as run, min(atom_idx) as first_idx, count(*) as n_atoms from runs group by sid, run")
def residue_runs(a: DataFrame) -> DataFrame:
    return residues.runs(a).groupBy("sid", "run").agg(F.min("atom_idx").alias("first_idx"), F.count("*").alias("n_atoms"))


for _label in "ab":
    _query(f"altloc_{_label}", f"{_WITH} select sid, atom_idx from atoms where altloc is null or altloc = '{_label.upper()}'")(lambda a, label=_label.upper(): residues.altloc(a, label).select("sid", "atom_idx"))

_query("altloc_all", _WITH + " select sid, atom_idx from atoms")(lambda a: residues.altloc(a, "all").select("sid", "atom_idx"))


@_query("altloc_occupancy", _WITH + """, sums as (
  select sid, chain, resi, icode, altloc, round(sum(occupancy), 6) as s, round(sum(case when name in ('N', 'CA', 'C', 'O') then occupancy end), 6) as bb from el where altloc is not null group by all
), best as (
  select sid, chain, resi, icode, altloc as label from (
    select *, row_number() over (partition by sid, chain, resi, icode order by case when has then bb else s end desc nulls last, altloc) as rk
    from (select *, max(bb) over (partition by sid, chain, resi, icode) is not null as has from sums)) where rk = 1
), copies as (
  select e.*, row_number() over (partition by e.sid, e.chain, e.resi, e.icode, e.name order by (e.altloc <> b.label), e.occupancy desc, e.altloc, e.atom_idx) as rk,
    min(e.atom_idx) over (partition by e.sid, e.chain, e.resi, e.icode, e.name) as place
  from el e join best b on e.sid = b.sid and e.chain = b.chain and e.resi = b.resi and e.icode is not distinct from b.icode where e.altloc is not null
) select sid, atom_idx, altloc, x from el where altloc is null union all select sid, place, altloc, x from copies where rk = 1""")
def altloc_occupancy(a: DataFrame) -> DataFrame:
    return residues.altloc(a, "occupancy").select("sid", "atom_idx", "altloc", "x")


@_query("calpha_trace", f"""{_WITH}, ca as (select *, lead(atom_idx) over w as b_idx, lead(chain) over w as b_chain, lead(resi) over w as b_resi, lead(x) over w as bx, lead(y) over w as by_, lead(z) over w as bz
  from atoms where name = 'CA' window w as (partition by sid order by atom_idx))
select sid, chain, resi as a_resi, b_resi, atom_idx as a_idx, b_idx from ca where chain = b_chain and b_resi = resi + 1""")
def calpha_trace(a: DataFrame) -> DataFrame:
    # bond lengths mean nothing among pseudo-atoms: C-alphas are put 3 ångström apart on a line
    nth = F.sum(F.when(F.col("name") == "CA", 3).otherwise(0)).over(Window.partitionBy("sid").orderBy("atom_idx"))
    line = a.withColumns({"x": nth, "y": F.lit(0).cast("long"), "z": F.lit(0).cast("long")})
    return residues.calpha_trace(line).drop("d2")


@_query("bfactor_range", _WITH + """, r as (select sid, b_factor, row_number() over (partition by sid order by b_factor) - 1 as i, count(*) over (partition by sid) as n from atoms)
select sid, max(case when i = floor(n * 0.02) then b_factor end) as low, max(case when i = floor(n * 0.98) then b_factor end) as high from r group by sid""")
def bfactor_range(a: DataFrame) -> DataFrame:
    return residues.bfactor_range(a)


@_query("extents", _WITH + " select sid, " + ", ".join(f"round(avg({c}) / 1000, 4) as center_{c}, min({c}) as min_{c}, max({c}) as max_{c}" for c in "xyz") + " from atoms group by sid")
def extents(a: DataFrame) -> DataFrame:
    return residues.extents(a, S)


# selection language --------------------------------------------------------

_METAL_SQL = f"element in {_in(C.METALS)}"
_WATER_SQL = f"resn in {_in(C.WATER)}"
_AMINO_SQL = f"resn in {_in(C.AMINO)}"
SELECTIONS = {
    "sel_classes": ("protein or ligand and not metal", f"{_AMINO_SQL} or (is_hetatm and not ({_WATER_SQL}) and not ({_METAL_SQL}))"),
    "sel_water": ("water", _WATER_SQL),
    "sel_metal_or_nucleic": ("metal or nucleic", f"{_METAL_SQL} or resn in {_in(C.NUCLEOTIDES)}"),
    "sel_boolean_ranges": ("chain A B and resi 10-400 700 and not (water or hetatm)", f"chain in ('A', 'B') and (resi between 10 and 400 or resi = 700) and not (({_WATER_SQL}) or is_hetatm)"),
    "sel_names": ("resn cys LYS and name SG nz or element zn", "(resn in ('CYS', 'LYS') and name in ('SG', 'NZ')) or element = 'ZN'"),
    "sel_bfactor": ("bfactor >= 40 or plddt < 3.5 and not none", "b_factor >= 40 or b_factor < 3.5"),
    "sel_within": ("within 4 of metal", f"exists (select 1 from el m where m.sid = e.sid and m.element = 'ZN' and {_d2('m', 'e')} <= 16000000)"),
    "sel_byres": ("byres name SG", "exists (select 1 from el m where m.sid = e.sid and m.name = 'SG' and m.chain = e.chain and m.resi = e.resi and m.icode is not distinct from e.icode)"),
    "sel_byres_within": ("byres within 3 of water and not water", f"exists (select 1 from el m where m.sid = e.sid and m.chain = e.chain and m.resi = e.resi and m.icode is not distinct from e.icode and exists (select 1 from el w where w.sid = m.sid and w.resn = 'HOH' and {_d2('w', 'm')} <= 9000000)) and not ({_WATER_SQL})"),
    "sel_not_within": ("not within 5 of metal and chain C", f"chain = 'C' and not exists (select 1 from el m where m.sid = e.sid and m.element = 'ZN' and {_d2('m', 'e')} <= 25000000)"),
}
for _name, (_text, _where) in SELECTIONS.items():
    _query(_name, f"{_WITH} select sid, atom_idx from el e where {_where}")(lambda a, text=_text: selection.select(text, a, S).select("sid", "atom_idx"))


# radius joins and contacts -------------------------------------------------

@_query("radius_pairs", f"{_WITH} select a.sid, a.atom_idx as a_idx, b.atom_idx as b_idx, {_d2('a', 'b')} as d2 from atoms a join atoms b on a.sid = b.sid and a.atom_idx < b.atom_idx where {_d2('a', 'b')} <= 4000000")
def radius_pairs(a: DataFrame) -> DataFrame:
    small = a.select("sid", "atom_idx", "x", "y", "z")
    return spatial.radius_join(small, small, 2.0, S, where=F.col("a_atom_idx") < F.col("b_atom_idx")).select(F.col("a_sid").alias("sid"), F.col("a_atom_idx").alias("a_idx"), F.col("b_atom_idx").alias("b_idx"), "d2")


def _flat(found: DataFrame) -> DataFrame:
    """A comparable form: the sides as text, the distance to 2 and the angle to 1 place."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "+")
    return found.select("sid", "kind", text("atoms_a").alias("atoms_a"), text("atoms_b").alias("atoms_b"), F.round("distance", 2).alias("distance"), F.round("angle", 1).alias("angle"), "bridge")


def _flat_sql(kind: str, a: str, b: str, d2: str, angle: str = "null", bridge: str = "null") -> str:
    return f"sid, '{kind}' as kind, cast({a} as varchar) as atoms_a, cast({b} as varchar) as atoms_b, round(sqrt(cast({d2} as double)) / 1000, 2) as distance, cast({angle} as double) as angle, cast({bridge} as int) as bridge"


_DISULFIDE = f"select {_flat_sql('disulfide', 'a', 'b', 'd2')} from (select a.sid, a.atom_idx as a, b.atom_idx as b, {_d2('a', 'b')} as d2 from el a join el b on a.sid = b.sid and a.atom_idx < b.atom_idx where a.name = 'SG' and b.name = 'SG' and a.resn = 'CYS' and b.resn = 'CYS') where d2 > 250000 and d2 <= 6250000"
_DONOR_SQL = f"(d.resn in {_in(C.WATER)} and d.element = 'O' or d.name in ('O', 'OXT') or " + " or ".join(f"d.resn = '{r}' and d.name in {_in(n)}" for r, n in C.METAL_DONORS.items()) + ")"
_METAL = f"select {_flat_sql('metal-coordination', 'a', 'b', 'd2')} from (select m.sid, m.atom_idx as a, d.atom_idx as b, {_d2('m', 'd')} as d2 from el m join el d on m.sid = d.sid where m.{_METAL_SQL} and {_DONOR_SQL}) where d2 > 250000 and d2 < 9000000"
_GROUPS = f"""sites as (select * from (values {_values([(r, s, n) for r, (s, names) in C.CHARGED.items() for n in names])}) t(resn, sign, name)), grp as (
  select r.sid, run, sign, min(chain) as chain, min(resi) as resi, min(icode) as icode, array_to_string(list_sort(list(atom_idx)), '+') as atoms, sum(x) / count(*) as x, sum(y) / count(*) as y, sum(z) / count(*) as z
  from runs r join sites s on r.resn = s.resn and r.name = s.name group by r.sid, run, sign)"""
_SALT = f"select {_flat_sql('salt-bridge', 'a', 'b', 'd2')} from (select a.sid, a.atoms as a, b.atoms as b, {_d2('a', 'b')} as d2 from grp a join grp b on a.sid = b.sid where a.sign > 0 and b.sign < 0 and {_other_residue('a', 'b')}) where d2 > 250000 and d2 < 30250000"

_query("disulfide", f"{_WITH} {_DISULFIDE}")(lambda a: _flat(interactions.disulfides(a, S)))
_query("metal_coordination", f"{_WITH} {_METAL}")(lambda a: _flat(interactions.metal_coordination(a, S)))
_query("salt_bridge", f"{_WITH}, {_RUNS}, {_GROUPS} {_SALT}")(lambda a: _flat(interactions.salt_bridges(a, S)))

_BONDS = f"""topo as (select * from (values {_values(C.side_chain_bonds())}) t(resn, a, b)), topo2 as (select * from topo union select resn, b, a from topo),
lastname as (select sid, run, name, max(atom_idx) as atom_idx from runs group by all),
radius as (select * from (values {_values([(k, v) for k, v in C.COVALENT.items()])}) t(element, radius)),
rad as (select e.*, r.radius from el e join radius r on e.element = r.element where not ({_WATER_SQL.replace('resn', 'e.resn')}) and not (e.{_METAL_SQL})),
cn as (select sid, run, min(chain) as chain, max(case when name = 'N' then atom_idx end) as n, max(case when name = 'C' then atom_idx end) as c from runs group by all),
pep as (select *, last_value(c ignore nulls) over (partition by sid order by run rows between unbounded preceding and 1 preceding) as pc from cn),
one as (
  select r.sid, r.atom_idx as a, l.atom_idx as b from runs r join topo2 t on r.resn = t.resn and r.name = t.a join lastname l on l.sid = r.sid and l.run = r.run and l.name = t.b where r.atom_idx < l.atom_idx
  union select p.sid, p.pc, p.n from pep p join el c on c.sid = p.sid and c.atom_idx = p.pc join el n on n.sid = p.sid and n.atom_idx = p.n where c.chain = n.chain and {_d2('c', 'n')} <= 6250000
  union select a.sid, a.atom_idx, b.atom_idx from rad a join rad b on a.sid = b.sid and a.atom_idx < b.atom_idx and abs(a.x - b.x) <= 2600 where {_other_residue('a', 'b')} and {_d2('a', 'b')} <= 6760000 and {_d2('a', 'b')} < ((a.radius + b.radius + 0.4) * 1000) * ((a.radius + b.radius + 0.4) * 1000)
), bond as (select sid, a, b from one union select sid, b, a from one)"""

_query("bond_graph", f"{_WITH}, {_RUNS}, {_BONDS} select sid, a as a_idx, b as b_idx from bond")(lambda a: bonds.graph(a, S))

_APOLAR = "apolar as (select e.* from el e where e.element = 'C' and exists (select 1 from bond b where b.sid = e.sid and b.a = e.atom_idx) and not exists (select 1 from bond b join el n on n.sid = b.sid and n.atom_idx = b.b where b.sid = e.sid and b.a = e.atom_idx and n.element <> 'C'))"
_HYDROPHOBIC = f"""raw as (select a.sid, a.atom_idx as a, b.atom_idx as b, a.chain as ac, a.resi as ar, a.icode as ai, b.chain as bc, b.resi as br, b.icode as bi, {_d2('a', 'b')} as d2 from apolar a join apolar b on a.sid = b.sid and a.atom_idx < b.atom_idx and abs(a.x - b.x) <= 4000 where {_other_residue('a', 'b')} and {_d2('a', 'b')} > 250000 and {_d2('a', 'b')} < 16000000),
p1 as (select * from (select *, row_number() over (partition by sid, a, bc, br, bi order by d2, a, b) as k from raw) where k = 1),
p2 as (select * from (select * exclude k, row_number() over (partition by sid, b, ac, ar, ai order by d2, a, b) as k from p1) where k = 1)"""
_query("hydrophobic", f"{_WITH}, {_RUNS}, {_BONDS}, {_APOLAR}, {_HYDROPHOBIC} select {_flat_sql('hydrophobic', 'a', 'b', 'd2')} from p2")(lambda a: _flat(interactions.detect(a, S, ("hydrophobic",))))


def _angle_sql(v: str, a: str, b: str) -> str:
    """Degrees at v; arguments are prefixes of columns x, y, z in ångström."""
    p, q = ([f"({s}{c} - {v}{c})" for c in "xyz"] for s in (a, b))
    dot = lambda m, n: "(" + " + ".join(f"{x} * {y}" for x, y in zip(m, n, strict=True)) + ")"
    size = f"(sqrt({dot(p, p)}) * sqrt({dot(q, q)}))"
    return f"(case when {size} > 1e-12 then degrees(acos(greatest(-1.0, least(1.0, {dot(p, q)} / {size})))) else 0.0 end)"


def _xyz(alias: str, name: str) -> str:
    return ", ".join(f"{alias}.{c} / 1000.0::double as {name}{c}" for c in "xyz")


_SOLE = lambda name, where: f"{name} as (select b.sid, b.a as idx, min(b.b) as nb from bond b join el n on n.sid = b.sid and n.atom_idx = b.b where n.element in {where} group by b.sid, b.a having count(*) = 1)"
_query("halogen_bond", f"""{_WITH}, {_RUNS}, {_BONDS}, {_SOLE('onec', "('C')")}, {_SOLE('onex', _in(C.ANTECEDENTS))}, p as (
  select h.sid, h.atom_idx as h, a.atom_idx as a, {_d2('h', 'a')} as d2, {_xyz('h', 'h')}, {_xyz('a', 'a')}, {_xyz('hc', 'c')}, {_xyz('an', 'n')}
  from el h join onec s on s.sid = h.sid and s.idx = h.atom_idx join el hc on hc.sid = h.sid and hc.atom_idx = s.nb
  join el a on a.sid = h.sid join onex t on t.sid = a.sid and t.idx = a.atom_idx join el an on an.sid = a.sid and an.atom_idx = t.nb
  where h.element = 'S' and a.element in ('O', 'N', 'S') and {_other_residue('h', 'a')})
select {_flat_sql('halogen-bond', 'h', 'a', 'd2', 'round(ah, 1)')} from (select *, {_angle_sql('h', 'a', 'c')} as ah, {_angle_sql('a', 'n', 'h')} as aa from p where d2 > 250000 and d2 < 16000000) where aa > 90 and aa < 150 and ah > 135 and ah < 195""")(
    lambda a: _flat(interactions.detect(a, S, ("halogen-bond",), halogens=("S",))))  # sulphur stands in: the tables have no halogen

#: Five backbone atoms stand in for a ring in every pseudo-residue.
_FIVE = ("N", "CA", "C", "O", "CB")
_PSEUDO_RINGS = {r: (_FIVE,) for r in C.AMINO}


def _newell(c: str) -> str:
    u, v = {"x": "yz", "y": "zx", "z": "xy"}[c]
    return " + ".join(f"(p{i}{u} - p{(i + 1) % 5}{u}) * (p{i}{v} + p{(i + 1) % 5}{v})" for i in range(5))


_RING_SQL = f"""head as (select sid, run, arg_min(resn, atom_idx) as resn from runs group by sid, run), firstname as (select sid, run, name, min(atom_idx) as atom_idx from runs group by all),
pos as (select l.sid, l.run, l.name, l.atom_idx, e.x / 1000.0::double as x, e.y / 1000.0::double as y, e.z / 1000.0::double as z, e.x as ix, e.y as iy, e.z as iz, e.chain, e.resi, e.icode from firstname l join el e on e.sid = l.sid and e.atom_idx = l.atom_idx join head on head.sid = l.sid and head.run = l.run where head.{_AMINO_SQL}),
five as (select p0.sid, p0.run, p0.chain, p0.resi, p0.icode, concat_ws('+', {', '.join(f'p{i}.atom_idx' for i in range(5))}) as atoms, {', '.join(f'p{i}.{c} as p{i}{c}' for i in range(5) for c in 'xyz')}, {', '.join('(' + ' + '.join(f'p{i}.i{c}' for i in range(5)) + f') / 5.0::double as {c}' for c in 'xyz')}
  from pos p0 {' '.join(f"join pos p{i} on p{i}.sid = p0.sid and p{i}.run = p0.run and p{i}.name = '{n}'" for i, n in enumerate(_FIVE) if i)} where p0.name = 'N'),
raw_ring as (select *, {', '.join(f'{_newell(c)} as m{c}' for c in 'xyz')} from five),
ring as (select *, {', '.join(f'm{c} / sqrt(mx * mx + my * my + mz * mz) as n{c}' for c in 'xyz')} from raw_ring where sqrt(mx * mx + my * my + mz * mz) > 1e-6)"""


def _offset_sql(q: str, r: str) -> str:
    d = {c: f"(({q}.{c} - {r}.{c}) / 1000.0)" for c in "xyz"}
    along = "(" + " + ".join(f"{d[c]} * {r}.n{c}" for c in "xyz") + ")"
    rest = [f"({d[c]} - {r}.n{c} * {along})" for c in "xyz"]
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in rest) + ")"


_query("pi_stacking", f"""{_WITH}, {_RUNS}, {_RING_SQL}, p as (select a.sid, a.atoms as a, b.atoms as b, {_d2('a', 'b')} as d2, least({_offset_sql('a', 'b')}, {_offset_sql('b', 'a')}) as off, degrees(acos(greatest(-1.0, least(1.0, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)))) as t
  from ring a join ring b on a.sid = b.sid and a.run < b.run where {_other_residue('a', 'b')})
select {_flat_sql('pi-stacking', 'a', 'b', 'd2', 'round(ang, 1)')} from (select *, least(t, 180 - t) as ang from p where d2 > 250000 and d2 < 30250000 and off < 2.0) where ang < 30 or ang > 60""")(
    lambda a: _flat(interactions.pi_stacking(interactions.rings(a, S, _PSEUDO_RINGS), S)))
_query("pi_cation", f"""{_WITH}, {_RUNS}, {_GROUPS}, {_RING_SQL} select {_flat_sql('pi-cation', 'a', 'b', 'd2')} from (select a.sid, a.atoms as a, b.atoms as b, {_d2('a', 'b')} as d2, {_offset_sql('b', 'a')} as off from ring a join grp b on a.sid = b.sid and b.sign > 0 where {_other_residue('a', 'b')}) where d2 > 250000 and d2 < 36000000 and off < 2.0""")(
    lambda a: _flat(interactions.pi_cation(interactions.rings(a, S, _PSEUDO_RINGS), interactions.charged_groups(a, S), S)))


def _serine(a: DataFrame) -> DataFrame:
    return hydrogens.donors(a, S).join(a.where("name = 'OG'").select("sid", "atom_idx"), ["sid", "atom_idx"], "left_semi")


def _rotor_sql(target: str) -> str:
    """x, y, z of the hydrogen of donor d (columns dx.., antecedent qx..) turned to a target, as columns of nested selects."""
    import math

    along, radius = -math.cos(math.radians(C.SP3)), math.sin(math.radians(C.SP3))
    return f"""select *, {', '.join(f'd{c} + (u{c} * {along!r} + o{c} / sqrt(ox * ox + oy * oy + oz * oz) * {radius!r}) as h{c}' for c in 'xyz')} from (
    select *, {', '.join(f't{c} - u{c} * (tx * ux + ty * uy + tz * uz) as o{c}' for c in 'xyz')} from (
    select *, {', '.join(f'(d{c} - q{c}) / sqrt((dx - qx) * (dx - qx) + (dy - qy) * (dy - qy) + (dz - qz) * (dz - qz)) as u{c}' for c in 'xyz')}, {', '.join(f'{target}{c} - d{c} as t{c}' for c in 'xyz')} from"""


_SER = f"""near as (select d.sid, d.atom_idx as d, arg_min(q.atom_idx, (case when q.altloc is not distinct from d.altloc then 0 when q.altloc is null then 1 else 2 end, q.atom_idx)) as atom_idx
  from runs d join runs q on q.sid = d.sid and q.run = d.run and q.name = 'CB' where d.name = 'OG' and d.resn = 'SER' group by d.sid, d.atom_idx),
ser as (select d.sid, d.atom_idx as d, d.chain, d.resi, d.icode, d.x, d.y, d.z, {_xyz('d', 'd')}, {_xyz('q', 'q')} from runs d join near l on l.sid = d.sid and l.d = d.atom_idx join el q on q.sid = l.sid and q.atom_idx = l.atom_idx)"""
_ACC = f"acc as (select * from el where {_AMINO_SQL} and (element = 'O' or resn = 'HIS' and name in ('ND1', 'NE2')))"
_query("hydrogen_bond")(lambda a: _flat(interactions.hydrogen_bonds(hydrogens.donors(a, S), roles.acceptors(a), S)))
_query("water_bridge")(lambda a: _flat(interactions.water_bridges(a, hydrogens.donors(a, S), roles.acceptors(a), S)))
_query("hydrogen_bond_hydroxyl", f"""{_WITH}, {_RUNS}, {_SER}, {_ACC}, p as (select s.*, a.atom_idx as a, {_xyz('a', 'a')}, {_d2('s', 'a')} as d2 from ser s join acc a on a.sid = s.sid where {_other_residue('s', 'a')} and {_d2('s', 'a')} > 250000 and {_d2('s', 'a')} < 16810000),
h as (select *, {_angle_sql('h', 'd', 'a')} as ang from ({_rotor_sql('a')} p)))), best as (select *, row_number() over (partition by sid, d order by ang desc, a) as k from h where ang > 100)
select {_flat_sql('hydrogen-bond', 'd', 'a', 'd2', 'round(ang, 1)')} from best where k = 1""")(lambda a: _flat(interactions.hydrogen_bonds(_serine(a), roles.acceptors(a), S)))
_query("water_bridge_hydroxyl", f"""{_WITH}, {_RUNS}, {_SER}, {_ACC}, wat as (select * from el where {_WATER_SQL} and element = 'O'),
leg as (select s.*, w.atom_idx as w, {_xyz('w', 'w')}, {_d2('s', 'w')} as d2a from ser s join wat w on w.sid = s.sid where {_d2('s', 'w')} between 6250000 and 16810000),
h as (select *, {_angle_sql('h', 'd', 'w')} as theta from ({_rotor_sql('w')} leg)))),
p as (select h.*, a.atom_idx as a, {_xyz('a', 'a')}, {_d2('a', 'v')} as d2b from h join wat v on v.sid = h.sid and v.atom_idx = h.w join acc a on a.sid = h.sid where theta > 100 and {_d2('a', 'v')} between 6250000 and 16810000 and {_other_residue('a', 'h')})
select {_flat_sql('water-bridge', 'd', 'a', 'greatest(d2a, d2b)', 'round(omega, 1)', 'w')} from (select *, {_angle_sql('w', 'a', 'h')} as omega from p) where omega > 71 and omega < 140""")(lambda a: _flat(interactions.water_bridges(a, _serine(a), roles.acceptors(a), S)))


#: The kinds that the SQL of the networks has; a caller narrows kinds in the same way.
_THREE = ("disulfide", "metal-coordination", "salt-bridge")


def _network_query(name: str, sql: str | None = None, find=lambda *x: interactions.detect(*x)):
    """A query over the contacts (or what else ``find`` makes) of all nine kinds, and if there is SQL the same over three kinds, held against it."""

    def add(f):
        _query(name)(lambda a: f(a, find(a, S)))
        if sql is not None:
            _query(f"{name}_three_kinds", sql)(lambda a: f(a, find(a, S, _THREE)))
        return f

    return add


@_network_query("interactions_touching", f"{_WITH}, {_RUNS}, {_GROUPS}, found as ({_DISULFIDE} union all {_METAL} union all {_SALT}) select f.* from found f where exists (select 1 from el e where e.sid = f.sid and e.chain = 'B' and list_contains(string_split(f.atoms_a || '+' || f.atoms_b, '+'), cast(e.atom_idx as varchar)))")
def interactions_touching(a: DataFrame, found: DataFrame) -> DataFrame:
    return _flat(interactions.touching(found, selection.select("chain B", a)))


@_query("interactions_all")
def interactions_all(a: DataFrame) -> DataFrame:
    """All nine kinds as report records."""
    return interactions.records(interactions.detect(a, S), a)


@_network_query("interactions_dedup")
def interactions_dedup(a: DataFrame, found: DataFrame) -> DataFrame:
    return _flat(interactions.dedup_conformers(found, a))


# networks ------------------------------------------------------------------

_ID = lambda e: f"{e}.chain || '/' || {e}.resi || coalesce({e}.icode, '')"
_LESS = "(a.chain, a.resi, coalesce(a.icode, '')) < (b.chain, b.resi, coalesce(b.icode, ''))"
_EDGES = f"""found as ({_DISULFIDE} union all {_METAL} union all {_SALT}), pairs as (
  select f.sid, f.kind, f.distance, case when {_LESS} then {_ID('a')} else {_ID('b')} end as source, case when {_LESS} then {_ID('b')} else {_ID('a')} end as target, a.chain <> b.chain as interchain
  from found f join el a on a.sid = f.sid and a.atom_idx = cast(split_part(f.atoms_a, '+', 1) as int) join el b on b.sid = f.sid and b.atom_idx = cast(split_part(f.atoms_b, '+', 1) as int) where {_other_residue('a', 'b')}),
energy as (select * from (values {_values(list(C.ENERGY.items()))}) t(kind, kj)),
edge as (select sid, source, target, p.kind, count(*) as "count", min(distance) as min_distance, bool_or(interchain) as interchain, cast(any_value(kj) as double) * count(*) as energy from pairs p join energy e on e.kind = p.kind group by sid, source, target, p.kind)"""
_NET = f"{_WITH}, {_RUNS}, {_GROUPS}, {_EDGES}"


def _edge_query(name: str, sql: str | None = None, once: bool = False):
    """``_network_query`` of the edges; ``once``: for a query that reads them once."""
    if once:
        return _network_query(name, sql, lambda *x: network.detected_edges(*x))
    return lambda f: _network_query(name, sql)(lambda a, found: f(a, network.edges(found, a)))


@_edge_query("rin_edges", f"{_NET} select * from edge")
def rin_edges(a: DataFrame, e: DataFrame) -> DataFrame:
    return e.withColumn("min_distance", F.round("min_distance", 2))


_edge_query("rin_edges_between_chains", f"{_NET} select sid, source, target, \"count\" from edge where interchain and kind = 'salt-bridge'")(lambda a, e: network.filter_edges(e, "salt-bridge", True).select("sid", "source", "target", "count"))
_ADJ = "adj as (select sid, source as u, target as v from edge union select sid, target, source from edge)"
_edge_query("rin_nodes", f"""{_NET}, {_ADJ}, deg as (select sid, u as id, count(distinct v) as degree from adj group by all) select d.sid, d.id, arg_min(e.resn, e.atom_idx) as resn, any_value(degree) as degree from deg d join el e on e.sid = d.sid and {_ID('e')} = d.id group by d.sid, d.id""")(lambda a, e: network.nodes(e, a).select("sid", "id", "resn", "degree"))
_edge_query("rin_components", f"""with recursive {pseudo.SQL}, {_RUNS}, {_GROUPS}, {_EDGES}, {_ADJ}, reach as (select sid, u, u as v from adj union select r.sid, r.u, a.v from reach r join adj a on a.sid = r.sid and a.u = r.v)
select sid, u as id, count(distinct v) as size from reach group by sid, u""", once=True)(lambda a, e: network.components(e).select("sid", "id", "size"))
_edge_query("rin_bfs_distance", f"""with recursive {pseudo.SQL}, {_RUNS}, {_GROUPS}, {_EDGES}, {_ADJ}, walk as (select sid, min(u) as v, 0 as d from adj group by sid union select w.sid, a.v, d + 1 from walk w join adj a on a.sid = w.sid and a.u = w.v where d < 40)
select sid, v as id, cast(min(d) as bigint) as distance from walk group by sid, v""")(lambda a, e: network.bfs_distance(e, e.where("source <> target").groupBy("sid").agg(F.least(F.min("source"), F.min("target")).alias("start"))))
_edge_query("rin_betweenness")(lambda a, e: network.betweenness(e))
_edge_query("rin_cut_residues", f"""with recursive {pseudo.SQL}, {_RUNS}, {_GROUPS}, {_EDGES}, {_ADJ}, reach as (
  select a.sid, a.u as cut, b.v as start, b.v as v from (select distinct sid, u from adj) a join adj b on b.sid = a.sid and b.u = a.u
  union select r.sid, r.cut, r.start, a.v from reach r join adj a on a.sid = r.sid and a.u = r.v where a.v <> r.cut)
select distinct a.sid, a.u as id from adj a join adj b on a.sid = b.sid and a.u = b.u and a.v < b.v where not exists (select 1 from reach r where r.sid = a.sid and r.cut = a.u and r.start = a.v and r.v = b.v)""", once=True)(lambda a, e: network.cut_residues(e))
_edge_query("rin_top_hubs")(lambda a, e: network.top_hubs(network.nodes(e, a), network.betweenness(e)))
_edge_query("rin_top_components", f"""with recursive {pseudo.SQL}, {_RUNS}, {_GROUPS}, {_EDGES}, {_ADJ}, reach as (select sid, u, u as v from adj union select r.sid, r.u, a.v from reach r join adj a on a.sid = r.sid and a.u = r.v),
place as (select sid, {_ID('e')} as id, min((chain, resi, coalesce(icode, ''))) as p from el e group by all), named as (select r.sid, r.u, arg_min(r.v, place.p) as component from reach r join place on place.sid = r.sid and place.id = r.v group by r.sid, r.u),
sized as (select sid, component, count(*) as size from named group by all)
select * from (select *, cast(row_number() over (partition by sid order by size desc, component) as int) as rank from sized) where rank <= 10""", once=True)(lambda a, e: network.top_components(network.components(e)))
_edge_query("rin_layout")(lambda a, e: network.layouts(e))
_edge_query("rin_kind_rollup", f"""{_NET} select sid, kind, count(*) as n_edges, cast(sum("count") as bigint) as n_contacts, round(sum(energy), 4) as energy from edge group by rollup (sid, kind)""", once=True)(lambda a, e: network.rollup(e))
_edge_query("edge_intensity", f"{_NET} select sid, source, target, kind, round(0.4 + 0.6 * ln(1 + energy) / ln(1 + max(energy) over (partition by sid)), 6) as intensity from edge")(
    lambda a, e: e.select("sid", "source", "target", "kind", F.round(scalars.edge_intensity(F.col("energy"), F.max("energy").over(Window.partitionBy("sid"))), 6).alias("intensity")))


# secondary structure -------------------------------------------------------

def _numbered(a: DataFrame) -> DataFrame:
    return residues.runs(a).groupBy("sid", "run").agg(F.min("chain").alias("chain"), F.min("resi").alias("resi"), F.min("icode").alias("icode"), F.min_by("resn", "atom_idx").alias("resn"))


def _pseudo_bonds(a: DataFrame) -> DataFrame:
    """Bonds from each run to others, three to five or a few dozen further, in both directions."""
    far = F.array(*(F.lit(k) for k in (3, 4, 5, 17, -17, 18, -19)))
    runs = residues.runs(a).groupBy("sid", "run").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    each = runs.select("sid", F.col("run").alias("acceptor"), F.posexplode(far).alias("k", "step"), "x", "y").where("(x + y + 7 * k) % 3 <> 0")
    return each.select("sid", "acceptor", (F.col("acceptor") + F.col("step")).alias("donor"), F.lit(-1.0).alias("energy")).join(runs.select("sid", F.col("run").alias("donor")), ["sid", "donor"], "left_semi")


_PBONDS = """res as (select sid, cast(run as bigint) as run, min(chain) as chain, sum(x) as sx, sum(y) as sy from runs group by sid, run),
b as (select r.sid, r.run as a, r.run + s.step as d from res r, (values (0, 3), (1, 4), (2, 5), (3, 17), (4, -17), (5, 18), (6, -19)) s(k, step) where (sx + sy + 7 * k) % 3 <> 0 and exists (select 1 from res q where q.sid = r.sid and q.run = r.run + s.step)),
t as (select b.sid, a as i, d - a as n from b join res p on p.sid = b.sid and p.run = a join res q on q.sid = b.sid and q.run = d where p.chain = q.chain and d - a in (3, 4, 5)),
h as (select t.sid, t.i, t.n from t join t u on u.sid = t.sid and u.n = t.n and u.i = t.i - 1),
nb as (select sid, run, chain, lag(chain) over (partition by sid order by run) is not distinct from chain and lead(chain) over (partition by sid order by run) is not distinct from chain as inside from res),
br as (select i.sid, i.run as i, j.run as j from nb i join nb j on i.sid = j.sid and i.run <> j.run and abs(i.run - j.run) <= 40 where not (i.chain = j.chain and abs(i.run - j.run) < 3) and (
   (i.inside and exists (select 1 from b where b.sid = i.sid and a = i.run - 1 and d = j.run) and exists (select 1 from b where b.sid = i.sid and a = j.run and d = i.run + 1))
   or (exists (select 1 from b where b.sid = i.sid and a = i.run and d = j.run) and exists (select 1 from b where b.sid = i.sid and a = j.run and d = i.run))
   or (i.inside and j.inside and exists (select 1 from b where b.sid = i.sid and a = i.run - 1 and d = j.run + 1) and exists (select 1 from b where b.sid = i.sid and a = j.run - 1 and d = i.run + 1))))"""
_query("dssp_ss", f"""{_WITH}, {_RUNS}, {_PBONDS} select r.sid, r.run, case
  when exists (select 1 from h where h.sid = r.sid and h.n = 4 and r.run between h.i and h.i + 3) then 'H'
  when exists (select 1 from br where br.sid = r.sid and (br.i = r.run or br.j = r.run)) then 'E'
  when exists (select 1 from h where h.sid = r.sid and h.n in (3, 5) and r.run between h.i and h.i + h.n - 1) then 'H'
  when exists (select 1 from t where t.sid = r.sid and r.run between t.i + 1 and t.i + t.n - 1) then 'T' else 'C' end as ss from res r""")(lambda a: dssp.structure(_numbered(a), _pseudo_bonds(a)))


def _pos(p: str, q: str) -> str:
    return "sqrt(" + " + ".join(f"({p}{c} - {q}{c}) * ({p}{c} - {q}{c})" for c in "xyz") + ")"


_query("dssp_hbonds_top2", f"""{_WITH}, {_RUNS}, nm as (select sid, cast(run as bigint) as run, min(chain) as chain, arg_min(resn, atom_idx) as resn, {', '.join(f"max(case when name = '{n}' then atom_idx end) as i{n}" for n in 'NCO')} from runs group by sid, run),
bb as (select m.*, {', '.join(f"{n}.{c} / 1000.0::double as {n}{c}" for n in 'nco' for c in 'xyz')} from nm m left join el n on n.sid = m.sid and n.atom_idx = m.iN left join el c on c.sid = m.sid and c.atom_idx = m.iC left join el o on o.sid = m.sid and o.atom_idx = m.iO),
pv as (select *, {', '.join(f'lag({n}{c}) over w as p{n}{c}' for n in 'co' for c in 'xyz')}, lag(chain) over w as pchain from bb window w as (partition by sid order by run)),
hh as (select *, {', '.join(f'n{c} + (pc{c} - po{c}) / {_pos("pc", "po")} as h{c}' for c in 'xyz')} from pv where pchain = chain and resn <> 'PRO' and nx is not null and pcx is not null and pox is not null and {_pos('pc', 'po')} > 1e-6 and {_pos('pc', 'n')} <= 30.0),
e as (select a.sid, a.run as acceptor, d.run as donor, {_pos('a.o', 'd.n')} as r1, {_pos('a.c', 'd.h')} as r2, {_pos('a.o', 'd.h')} as r3, {_pos('a.c', 'd.n')} as r4 from bb a join hh d on a.sid = d.sid and a.run <> d.run and not (a.chain = d.chain and abs(a.run - d.run) = 1) where a.cx is not null and a.ox is not null and {_pos('a.o', 'd.n')} <= 6.0),
f as (select sid, acceptor, donor, case when least(r1, r2, r3, r4) < 0.1 then 0.0 else greatest({C.DSSP_FACTOR!r}::double * (1 / r1 + 1 / r2 - 1 / r3 - 1 / r4), -9.9) end as energy from e)
select sid, acceptor, donor, round(energy, 4) as energy from (select *, row_number() over (partition by sid, donor order by energy, acceptor) as k from f where energy < -0.5) where k <= 2""")(
    lambda a: dssp.bonds(dssp.backbone(a, S, peptide=30.0)).select("sid", "acceptor", "donor", F.round("energy", 4).alias("energy")))  # a wide peptide bond: pseudo-residues aren't chained
_query("backbone_graph_degree", f"{_WITH}, {_RUNS}, {_PBONDS} select r.sid, r.run, (select count(*) from b where b.sid = r.sid and b.a = r.run) + (select count(*) from b where b.sid = r.sid and b.d = r.run) as degree from res r")(lambda a: network.backbone_graph(_numbered(a), _pseudo_bonds(a))[0].select("sid", "run", "degree"))
_query("hbond_sheet_ladders", f"{_WITH}, {_RUNS}, {_PBONDS} select distinct x.sid, x.a as start from b x join b y on x.sid = y.sid and x.a = y.d and x.d = y.a where x.d - x.a > 4")(
    lambda a: (lambda n, l: network.motifs(n, l, dssp.structure(_numbered(a), _pseudo_bonds(a))).where("motif = 'sheet'").select("sid", "start").distinct())(*network.backbone_graph(_numbered(a), _pseudo_bonds(a))))
_query("hbond_motifs")(lambda a: (lambda n, l: network.motifs(n, l, dssp.structure(_numbered(a), _pseudo_bonds(a))))(*network.backbone_graph(_numbered(a), _pseudo_bonds(a))))
_query("backbone_components")(lambda a: network.weak_components(_pseudo_bonds(a).select("sid", F.col("acceptor").alias("source"), F.col("donor").alias("target"))))


# surface -------------------------------------------------------------------

_query("sasa_residue")(lambda a: sasa.residue_areas(a, S))


# scalar tables and strings -------------------------------------------------

_query("residue_scales", f"{_WITH}, asa as (select * from (values {_values(list(C.MAX_ASA.items()))}) t(resn, asa)), hyd as (select * from (values {_values(list(C.HYDROPATHY.items()))}) t(resn, h)) select e.resn, count(*) as n, cast(any_value(asa) as double) as max_asa, cast(coalesce(any_value(h), 0) as double) as hydropathy from el e left join asa on asa.resn = e.resn left join hyd on hyd.resn = e.resn group by e.resn")(
    lambda a: a.groupBy("resn").agg(F.count("*").alias("n")).select("resn", "n", scalars.max_asa(F.col("resn")).cast("double").alias("max_asa"), scalars.hydropathy(F.col("resn")).cast("double").alias("hydropathy")))
_query("vdw_volume", f"{_WITH}, r as (select * from (values {_values(list(C.VDW.items()))}) t(element, r)) select sid, e.element, count(*) as n, round(cast(any_value(coalesce(r, {C.VDW_OTHER})) as double), 2) as radius from el e left join r on r.element = e.element group by sid, e.element")(
    lambda a: a.groupBy("sid", "element").agg(F.count("*").alias("n")).select("sid", "element", "n", F.round(scalars.vdw_radius(F.col("element")).cast("double"), 2).alias("radius")))


@_table_query("assembly_operator_count", """select l_orderkey % 97 as k, cast(sum(case l_linenumber % 4 when 0 then 1 when 1 then l_linenumber + 2 when 2 then (l_linenumber + 1) * 2 else 3 end) as bigint) as n_operators from lineitem group by k""")
def assembly_operator_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 0, "P").when(n % 4 == 1, F.format_string("1-%d, 77", n + 1)).when(n % 4 == 2, F.format_string("(0-%d)(A,B)", n)).otherwise("1,2, X0")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 97).alias("k"), scalars.count_operators(text).alias("n"))
    return line.groupBy("k").agg(F.sum("n").alias("n_operators"))


# validation metrics --------------------------------------------------------

@_query("metrics_q3", _WITH + " select sid, round(avg(case when (case when name in ('N', 'CA') then 'H' when name = 'C' then 'E' else 'C' end) = (case when altloc = 'A' then 'H' when altloc = 'B' then 'E' else 'C' end) then 1.0 else 0.0 end), 6) as q3 from atoms group by sid")
def metrics_q3(a: DataFrame) -> DataFrame:
    p = F.when(F.col("name").isin("N", "CA"), "H").when(F.col("name") == "C", "E").otherwise("C")
    r = F.when(F.col("altloc") == "A", "H").when(F.col("altloc") == "B", "E").otherwise("C")
    return a.select("sid", p.alias("predicted"), r.alias("reference")).groupBy("sid").agg(F.round(validation.q3("predicted", "reference"), 6).alias("q3"))


@_query("metrics_error_stats", _WITH + " select sid, round(avg(abs(occupancy - b_factor / 50)), 6) as mae, round(median(abs(occupancy - b_factor / 50)), 6) as median_error, round(coalesce(corr(occupancy, b_factor / 50), 0), 6) as pearson from atoms group by sid")
def metrics_error_stats(a: DataFrame) -> DataFrame:
    pairs = a.select("sid", F.col("occupancy").alias("p"), (F.col("b_factor") / 50).alias("r"))
    return pairs.groupBy("sid").agg(*(F.round(c, 6).alias(n) for n, c in validation.error_stats("p", "r").items()))


@_edge_query("metrics_prf1", f"""{_NET}, p as (select distinct sid, kind, source, target from edge where "count" < 3), r as (select distinct sid, kind, source, target from edge where min_distance > 2),
n as (select sid, kind, sum(p) as np, sum(r) as nr, sum(p * r) as tp from (select coalesce(p.sid, r.sid) as sid, coalesce(p.kind, r.kind) as kind, (p.sid is not null)::int as p, (r.sid is not null)::int as r from p full join r on p.sid = r.sid and p.kind = r.kind and p.source = r.source and p.target = r.target) group by all)
select sid, kind, cast(np as bigint) as n_predicted, cast(nr as bigint) as n_reference, cast(tp as bigint) as n_common, round(case when np = 0 then (nr = 0)::int::double else tp / np end, 6) as precision, round(case when nr = 0 then (np = 0)::int::double else tp / nr end, 6) as recall from n""")
def metrics_prf1(a: DataFrame, e: DataFrame) -> DataFrame:
    e = e.withColumn("min_distance", F.round("min_distance", 2))
    found = validation.set_agreement(e.where("count < 3"), e.where("min_distance > 2"))
    return found.select("sid", "kind", "n_predicted", "n_reference", "n_common", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@_table_query("stream_events_hourly", "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def stream_events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming count in strandex.streaming."""
    from strandex.streaming import structures

    return structures.counts_by_hour(spark.read.parquet(f"{sf_dir}/events.parquet"))
