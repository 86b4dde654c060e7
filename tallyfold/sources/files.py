"""Readers for the file kinds of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from ..functions.text import path_part, path_part_starting


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str, separator: str = ",") -> DataFrame:
    """CSV or TSV with a header line; gzip is recognised by the file name."""
    return (
        spark.read.schema(schema).option("header", True).option("sep", separator).option("escape", '"').csv(path)
    )


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet, only the named columns."""
    return spark.read.parquet(path).select(*columns)


def read_many(spark: SparkSession, path: str | list[str], merge_schema: bool = False) -> DataFrame:
    """All parquet files below a directory or glob as one table."""
    reader = spark.read.option("recursiveFileLookup", True)
    if merge_schema:
        reader = reader.option("mergeSchema", True)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_for_ids(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given datasets. The ids stay a table, so their number does not matter."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def read_key_values(spark: SparkSession, root: str, id_prefix: str, pattern: str = "Summary.csv") -> DataFrame:
    """Headerless `category,value` files below `root`: `(accession, feature, category, value, path)`.

    The accession is the first path part with the prefix, the feature the folder
    of the file. Files outside such a folder are left out.
    """
    schema = StructType([StructField("category", StringType()), StructField("value", StringType())])
    rows = (
        spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    folder = F.regexp_replace(path_part("path", -2), "^[^=]*=", "")
    return rows.select(
        path_part_starting("path", id_prefix).alias("accession"), folder.alias("feature"), "category", "value", "path",
    ).where(F.col("accession").isNotNull())


def manifest(spark: SparkSession, root: str, pattern: str = "*", id_prefix: str | None = None) -> DataFrame:
    """Files below `root`: path, name, folder, size and time. Contents are not read.

    With `id_prefix` the accession is taken from the path, the feature is the
    folder below it and the processing the folder of the file.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(root).select("path", "length", "modificationTime")
        .withColumn("file", path_part("path", -1))
        .withColumn("folder", path_part("path", -2))
    )
    if id_prefix is None:
        return files
    plain = F.regexp_replace(F.col("path"), r"/[^/=]+=", "/")
    below = F.split(F.regexp_extract(plain, rf"/{id_prefix}[^/]*/(.*)$", 1), "/")
    return files.select(
        path_part_starting("path", id_prefix).alias("accession"), below.getItem(0).alias("feature"),
        F.regexp_replace("folder", "^[^=]*=", "").alias("processing"), "file", "length", "path",
    ).where(F.col("accession").isNotNull())


def read_nested_counts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON objects `{outer: {label: n}}` as rows `(outer, counts)`, counts a map.

    `multi_line=True` reads one object per file, else one per line, which splits.
    """
    inner = MapType(StringType(), LongType())
    if multi_line:
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.read.text(path)
    parsed = F.from_json("value", MapType(StringType(), inner))
    return text.select(F.explode(parsed).alias("outer", "counts"))


def read_id_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """One id per line; blank lines and, if wanted, `#` lines are skipped."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return ids.where(~F.col("id").startswith("#")) if comments else ids


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """Two-column TSV with a header: species and accession; further columns are ignored."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    first, second = rows.columns[:2]
    return rows.select(F.col(first).alias("species"), F.col(second).alias("accession"))


def run_table(rows: DataFrame) -> DataFrame:
    """Run table as `(name, experiment, run)`, unnamed libraries marked, sorted by all three."""
    named = F.coalesce(F.nullif(F.trim("LibraryName"), F.lit("")), F.lit("No title available"))
    return rows.select(
        named.alias("name"), F.col("Experiment").alias("experiment"), F.col("Run").alias("run")
    ).orderBy("name", "experiment", "run")


def read_runs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Run records, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_cells(spark: SparkSession, counts: str, obs: str, var: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of an annotated matrix: counts, cells and genes."""
    return (
        spark.read.parquet(counts).select("cell_id", "gene_id", "count").where("count > 0"),
        spark.read.parquet(obs), spark.read.parquet(var),
    )


def observations(obs: DataFrame, columns: Sequence[str], **tags: str) -> DataFrame:
    """Chosen columns of a cell table, with constant tag columns."""
    return obs.select(*columns, *[F.lit(v).alias(k) for k, v in tags.items()])


def sample_results(results: DataFrame, metadata: DataFrame, feature: str, **equal: str) -> DataFrame:
    """Results of one feature joined to the metadata that has the given values.

    The feature name is compared without case.
    """
    wanted: Column = F.lower("feature") == feature.lower()
    kept = metadata
    for column, value in equal.items():
        kept = kept.where(F.col(column) == value)
    return results.where(wanted).join(kept, results["sample"] == kept["accession"]).drop(kept["accession"])


def projects_of(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """Project and study of each listed experiment."""
    return metadata.join(ids.select(F.col(ids.columns[0]).alias("experiment")).distinct(), "experiment", "left_semi").select(
        "experiment", "project", "study").distinct()


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
               properties: dict[str, str]) -> DataFrame:
    """A database table over JDBC, read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts,
                           properties=properties)
