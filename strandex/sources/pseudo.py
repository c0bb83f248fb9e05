"""Deterministic pseudo-atoms made from ``lineitem``: structures for whole-table checks.

Coordinates are integers (thousandths of an ångström), so distance comparisons
are exact in every engine.  ``SQL`` is the same table for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units of the coordinates in an ångström.
SCALE = 1000
_RESIDUES = "ALAARGASNASPCYSGLNGLUGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVAL"
_SIX = {"CYS": "SG", "LYS": "NZ", "SER": "OG"}

SQL = f"""atoms as (
  select sid, cast(row_number() over (partition by sid order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) as int) as atom_idx,
    case when kind = 'W' then 'O' when kind = 'M' then 'ZN' else case l_linenumber when 1 then 'N' when 2 then 'CA' when 3 then 'C' when 4 then 'O' when 5 then 'CB'
      else case aa when 'CYS' then 'SG' when 'ASP' then case l_linenumber when 6 then 'OD1' else 'OD2' end when 'LYS' then 'NZ' when 'SER' then 'OG' else case l_linenumber when 6 then 'CG' else 'CD' end end end end as name,
    case when kind = 'W' then 'HOH' when kind = 'M' then 'ZN' else aa end as resn,
    cast(l_orderkey as int) as resi, substr('ABCD', 1 + (cast(floor(l_orderkey / 250) as int) % 4), 1) as chain,
    case when l_orderkey % 50 = 0 then 'A' end as icode, kind <> 'P' as is_hetatm,
    case l_returnflag when 'A' then 'A' when 'R' then 'B' end as altloc, 0.5 + l_discount as occupancy, l_quantity as b_factor, x, y, z
  from (select *, cast(floor(l_orderkey / 1000) as int) as sid,
      substr('{_RESIDUES}', cast(1 + 3 * ((l_orderkey * 7) % 20) as int), 3) as aa,
      case when l_partkey % 53 = 0 then 'W' when l_partkey % 97 = 0 then 'M' else 'P' end as kind,
      cast((l_partkey * 7919 + l_orderkey * 104729) % 40000 as bigint) as x,
      cast((l_suppkey * 6271 + l_partkey * 31 + l_linenumber * 977) % 40000 as bigint) as y,
      cast((l_orderkey * 8191 + l_linenumber * 523 + l_partkey) % 40000 as bigint) as z from lineitem) t
), el as (select *, case when resn = 'ZN' then 'ZN' else substr(name, 1, 1) end as element from atoms)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, atom_idx, name, resn, resi, chain, icode, is_hetatm, altloc, occupancy, b_factor, x, y, z, element."""
    c = F.col
    # All that isn't made of other columns has a place in the order, which it settles among equal rows: so whatever a query
    # needs of the atoms, its shuffle of them is the same, and Spark makes it once.
    order = Window.partitionBy("sid").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_discount")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("sid", F.floor(c("l_orderkey") / 1000).cast("int")).withColumn("atom_idx", F.row_number().over(order).cast("int")).withColumns({
        "aa": F.substring(F.lit(_RESIDUES), (1 + 3 * ((c("l_orderkey") * 7) % 20)).cast("int"), F.lit(3)),
        "kind": F.when(c("l_partkey") % 53 == 0, "W").when(c("l_partkey") % 97 == 0, "M").otherwise("P"),
        "x": (c("l_partkey") * 7919 + c("l_orderkey") * 104729) % 40000,
        "y": (c("l_suppkey") * 6271 + c("l_partkey") * 31 + c("l_linenumber") * 977) % 40000,
        "z": (c("l_orderkey") * 8191 + c("l_linenumber") * 523 + c("l_partkey")) % 40000,
    })
    n = c("l_linenumber")
    side = F.when(c("aa") == "ASP", F.when(n == 6, "OD1").otherwise("OD2"))
    for resn, name in _SIX.items():
        side = side.when(c("aa") == resn, name)
    side = side.otherwise(F.when(n == 6, "CG").otherwise("CD"))
    name = F.when(c("kind") == "W", "O").when(c("kind") == "M", "ZN").when(n == 1, "N").when(n == 2, "CA").when(n == 3, "C").when(n == 4, "O").when(n == 5, "CB").otherwise(side)
    resn = F.when(c("kind") == "W", "HOH").when(c("kind") == "M", "ZN").otherwise(c("aa"))
    return line.select(
        "sid", "atom_idx", name.alias("name"), resn.alias("resn"), c("l_orderkey").cast("int").alias("resi"),
        F.substring(F.lit("ABCD"), (1 + F.floor(c("l_orderkey") / 250).cast("int") % 4), F.lit(1)).alias("chain"),
        F.when(c("l_orderkey") % 50 == 0, "A").alias("icode"), (c("kind") != "P").alias("is_hetatm"),
        F.when(c("l_returnflag") == "A", "A").when(c("l_returnflag") == "R", "B").alias("altloc"), (0.5 + c("l_discount")).alias("occupancy"), c("l_quantity").alias("b_factor"), "x", "y", "z",
        F.when(c("kind") == "M", "ZN").otherwise(F.substring(name, 1, 1)).alias("element"),
    )
