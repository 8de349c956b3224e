"""Readers of occurrence parts, id lists, names, site lists and intermediate tables."""

from __future__ import annotations

import csv
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import canonical_id, strip

#: Texts that mean a missing value in delimited files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Header names of focal lists.
ID_NAMES = ("taxonID", "TaxonID", "taxonId", "id")
TAXON_NAMES = ("name", "scientificName", "scientific_name")

OCCURRENCE = T.StructType([T.StructField(c, T.StringType()) for c in ("decimalLongitude", "decimalLatitude", "taxonID", "scientificName", "vernacularName", "eventDate", "localityID", "locality")])
OPTIONAL = ("localityID", "locality")


def conform(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns: absent optional ones as NULL, absent required ones are an error."""
    lacking = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if lacking:
        raise ValueError(f"missing columns {lacking}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts that mean a missing value become NULL."""
    return df.withColumns({c: F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)) for c in (columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])})


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet parts below a folder; columns that only some parts have are NULL in the others."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(path)
    return conform(raw, OCCURRENCE, OPTIONAL)


def parts(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet parts of a pattern with the file that each row comes from."""
    return spark.read.parquet(pattern).withColumn("file", F.col("_metadata.file_path"))


def _csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True)


def id_list(spark: SparkSession, path: str, column: str = "Taxon id", required: bool = True) -> DataFrame:
    """(id,): distinct integer ids of a semicolon list, as text; without ``required`` the first column stands in."""
    df = _csv(spark, path, ";")
    if column not in df.columns:
        if required:
            raise ValueError(f"no column {column!r}")
        column = df.columns[0]
    return with_nulls(df.select(F.col(f"`{column}`").alias("id"))).filter("id IS NOT NULL").select(canonical_id(F.col("id")).alias("id")).distinct()


def exclude_list(spark: SparkSession, path: str | None) -> DataFrame:
    """(id,): trimmed ids to leave out; a missing file excludes nothing."""
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], "id string")
    df = _csv(spark, path, ";")
    if "taxonID" not in df.columns:
        raise ValueError("no column 'taxonID'")
    return df.select(strip(F.col("taxonID")).alias("id")).filter("id IS NOT NULL AND id <> ''").distinct()


def file_order() -> Column:
    """A number that grows along each file, however it is split: the start of a row's block, then its place among the rows of its task.

    Splits are planned by size and not by place, so an id of task and row alone does not follow the file.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(10,0)") + place.cast("decimal(10,0)")


def name_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(species_id, name, rank): vernacular names; the first of an id in file order has the least rank."""
    df = _csv(spark, path, ";").withColumn("__row", file_order())
    return with_nulls(df.select(strip(F.col("taxonID")).alias("species_id"), strip(F.col("vernacular")).alias("name"), F.col("__row").alias("rank")), ["species_id", "name"])


def focal_list(spark: SparkSession, path: str, ids: list[str] = (), names: list[str] = ()) -> DataFrame:
    """(kind, value): distinct focal ids and names of a file and of the arguments.

    The separator (comma, semicolon or tab) is sniffed in the first 4,096 characters; lines that begin with # are
    comments; ids that are no integers are left out with a warning; a missing file adds nothing.
    """
    out = spark.createDataFrame([("id", str(i)) for i in ids] + [("name", n) for n in names], "kind string, value string")
    if not _exists(spark, path):
        warnings.warn(f"{path} is missing", stacklevel=2)
        return out.distinct()
    head = "\n".join(r["value"] for r in spark.read.text(path).filter(~F.col("value").startswith("#")).limit(50).collect())[:4096]
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",;\t").delimiter
    except csv.Error:
        sep = ","
    df = spark.read.csv(path, sep=sep, header=True, comment="#")
    pick = lambda aliases: next((strip(F.col(f"`{a}`")) for a in aliases if a in df.columns), F.lit(None).cast("string"))
    rows = df.select(pick(ID_NAMES).alias("id"), pick(TAXON_NAMES).alias("name"))
    bad = rows.filter("id IS NOT NULL AND id <> '' AND try_cast(id AS bigint) IS NULL").count()
    if bad:
        warnings.warn(f"{bad} ids of {path} are no integers", stacklevel=2)
    found = rows.select(F.lit("id").alias("kind"), F.expr("cast(try_cast(id AS bigint) AS string)").alias("value")).union(rows.select(F.lit("name"), "name"))
    return out.union(found.filter("value IS NOT NULL AND value <> ''")).distinct()


def locality_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, row, locality_id, latband, n, e, species_ids) of tab-separated site lists; the band is optional."""
    df = spark.read.csv(pattern, sep="\t", header=True).withColumns({"file": F.col("_metadata.file_path"), "row": file_order()})
    band = F.col("latband") if "latband" in df.columns else F.lit(None).cast("string")
    out = df.select("file", "row", F.col("LocalityID").alias("locality_id"), band.alias("latband"), F.col("SWEREF_N").alias("n"), F.col("SWEREF_E").alias("e"), F.col("Species_IDs").alias("species_ids"))
    return with_nulls(out, ["locality_id", "latband", "n", "e", "species_ids"]).withColumns({c: F.col(c).try_cast("double") for c in ("n", "e")})


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV or TSV table, by its ending."""
    if path.endswith((".tsv", ".txt")):
        return spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def species_names(index: DataFrame, names: DataFrame | None) -> DataFrame:
    """(col_index, species): names by index; absent ones are made up from the index."""
    made = F.format_string("sp_%05d", F.col("col_index"))
    if names is None:
        return index.select("col_index", made.alias("species"))
    column = "species" if "species" in names.columns else names.columns[0]
    return index.select("col_index").join(names.select("col_index", F.col(column).alias("__name")), "col_index", "left").select("col_index", F.coalesce("__name", made).alias("species"))


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    return any_table(spark, path) if _exists(spark, path) else None


def latest(spark: SparkSession, pattern: str) -> str:
    """The lexically last path of a pattern."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    paths = sorted(str(f.getPath().toString()) for f in found or [])
    if not paths:
        raise FileNotFoundError(pattern)
    return paths[-1]


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def numeric(c: str) -> Column:
    return F.col(c).try_cast("double")
