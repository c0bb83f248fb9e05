"""Reference answers and settings: JSON of other programs, TOML manifests."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "struct<chain:string,seq:long,icode:string>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file; the structure's id is the name up to the first dot."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("sid", F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)\.[^/]*$", 1))


def secondary_structure(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, "residues array<struct<chain:string,seq:long,icode:string,ss:string>>").select("sid", F.explode("residues").alias("r"))
    return rows.select("sid", "r.chain", F.col("r.seq").cast("int").alias("resi"), "r.icode", "r.ss")


def surface(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, "residues array<struct<chain:string,seq:long,icode:string,sasa:double>>").select("sid", F.explode("residues").alias("r"))
    return rows.select("sid", "r.chain", F.col("r.seq").cast("int").alias("resi"), "r.icode", "r.sasa")


def _edges(rows: DataFrame, kind, a: str, b: str) -> DataFrame:
    name = lambda c: F.concat(F.col(f"{c}.chain"), F.lit("/"), F.col(f"{c}.seq").cast("string"), F.coalesce(F.col(f"{c}.icode"), F.lit("")))
    key = lambda c: F.struct(F.col(f"{c}.chain"), F.col(f"{c}.seq"), F.coalesce(F.col(f"{c}.icode"), F.lit("")))
    swap = key(b) < key(a)
    return rows.select("sid", kind.alias("kind"), F.when(swap, name(b)).otherwise(name(a)).alias("source"), F.when(swap, name(a)).otherwise(name(b)).alias("target")).distinct()


def backbone_bonds(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the files that have bonds; a file without the field isn't scored."""
    rows = _read(spark, path, f"hbonds array<struct<donor:{_KEY},acceptor:{_KEY}>>").where("hbonds is not null").select("sid", F.explode("hbonds").alias("h"))
    return _edges(rows, F.lit("backbone"), "h.donor", "h.acceptor")


def bond_scope(spark: SparkSession, path: str) -> DataFrame:
    """The files that score backbone bonds, also those without any: sid, kinds, ligand_scoped."""
    return _read(spark, path, f"hbonds array<struct<donor:{_KEY},acceptor:{_KEY}>>").where("hbonds is not null").select("sid", F.array(F.lit("backbone")).alias("kinds"), F.lit(False).alias("ligand_scoped"))


def contacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (sid, kind, source, target), and what each file scores: sid, kinds, ligand_scoped."""
    files = _read(spark, path, f"kinds array<string>, ligand_scoped boolean, interactions array<struct<kind:string,a:{_KEY},b:{_KEY}>>")
    rows = files.select("sid", F.explode("interactions").alias("i"))
    return _edges(rows, F.col("i.kind"), "i.a", "i.b"), files.select("sid", "kinds", "ligand_scoped")


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """stratum, sid of a TOML manifest's strata."""
    strata = tomllib.loads(text).get("strata", {})
    return spark.createDataFrame([(s, x) for s, ids in strata.items() for x in ids], "stratum string, sid string")


def thresholds(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in tomllib.loads(text).items() if isinstance(v, int | float)}
