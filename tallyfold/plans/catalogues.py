"""Comparison of catalogues and checks of their files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import clean_counts
from ..functions.text import snake_columns
from ..operators.aggregate import group_sum, to_wide
from ..operators.grid import complete
from ..operators.joins import drop_in, first_row, keep_in
from ..operators.windows import top_labels
from ..session import materialize

# Matrix files each feature must have, by processing step. `*` is any other feature.
_MATRIX = ("matrix.mtx.gz", "barcodes.tsv.gz", "features.tsv.gz")
_VELOCITY = ("spliced.mtx.gz", "unspliced.mtx.gz", "ambiguous.mtx.gz", "barcodes.tsv.gz", "features.tsv.gz")
_MULTI = ("UniqueAndMult-EM.mtx.gz", "UniqueAndMult-Uniform.mtx.gz")
REQUIRED_FILES = {
    ("Velocyto", "raw"): _VELOCITY,
    ("Velocyto", "filtered"): _VELOCITY + _MULTI,
    ("*", "raw"): _MATRIX + _MULTI,
    ("*", "filtered"): _MATRIX + _MULTI,
}
# The same for data sets that come without a public accession.
REQUIRED_FILES_PRIVATE = {
    ("Velocyto", "raw"): _VELOCITY,
    ("Velocyto", "filtered"): _VELOCITY,
    ("*", "raw"): _MATRIX + _MULTI,
    ("*", "filtered"): _MATRIX,
}

# Feature names that summary categories may carry.
FEATURE_NAMES = ("Gene", "GeneFull", "GeneFull_Ex50pAS", "GeneFull_ExonOverIntron", "Velocyto")

# Result columns held as whole numbers.
COUNT_COLUMNS = ("estimated_number_of_cells", "number_of_reads", "umis_in_cells")


def compare_catalogues(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str,
                       top_n: int | None = None, scale: float = 1.0) -> DataFrame:
    """Sums per key and catalogue, with zeros where a catalogue lacks a key.

    `top_n` keeps the values of the first key that have the largest single sum.
    """
    keys = list(keys)
    tagged = [
        group_sum(df, keys, **{value: value}).withColumn("catalogue", F.lit(name)) for name, df in sources.items()
    ]
    sums = materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), "sums")
    if top_n:
        sums = sums.join(top_labels(sums, keys[0], value, top_n, how="max"), keys[0], "left_semi")
    return complete(sums, [*keys, "catalogue"]).withColumn("scaled", F.col(value) / scale)


def required_files(spark: SparkSession, table: Mapping[tuple[str, str], Sequence[str]] = REQUIRED_FILES) -> DataFrame:
    rows = [(feature, step, name) for (feature, step), names in table.items() for name in names]
    return spark.createDataFrame(rows, "feature string, processing string, file string")


def _file_gaps(files: DataFrame, required: DataFrame) -> DataFrame:
    """For each accession and feature the array of required files it lacks.

    The set gathered per pair holds required files only, so it is as short as
    the list of them, and the manifest is read once.
    """
    item = F.struct("processing", "file")
    lists = required.groupBy(F.col("feature").alias("_rule")).agg(F.collect_set(item).alias("_wanted"))
    own = lists.where("_rule <> '*'").select(F.col("_rule").alias("feature"), "_rule")
    ruled = files.join(own, "feature", "left").fillna({"_rule": "*"})
    known = required.select(F.col("feature").alias("_rule"), "processing", "file", F.lit(True).alias("_known")).distinct()
    found = ruled.join(known, ["_rule", "processing", "file"], "left")
    present = found.groupBy("accession", "feature", "_rule").agg(F.collect_set(F.when(F.col("_known"), item)).alias("_present"))
    return present.join(lists, "_rule").select(
        "accession", "feature", F.array_except("_wanted", "_present").alias("missing"))


def missing_files(files: DataFrame, required: DataFrame) -> DataFrame:
    """Required files a manifest lacks, for every accession and feature it has."""
    gaps = _file_gaps(files, required).select("accession", "feature", F.explode("missing").alias("_m"))
    return gaps.select("accession", "feature", "_m.processing", "_m.file")


def complete_datasets(files: DataFrame, required: DataFrame) -> DataFrame:
    """`(accession, feature)` pairs with no required file missing."""
    return _file_gaps(files, required).where(F.size("missing") == 0).select("accession", "feature")


def result_table(pairs: DataFrame, complete_ids: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key/value rows of many samples as one clean row per sample and feature.

    The feature's own name inside a category becomes `feature`; only samples in
    `complete_ids` are kept; names are lower case with `_`; values are numbers.
    `names` are the categories that become columns, after that replacement.
    """
    pattern = " (?:" + "|".join(sorted(FEATURE_NAMES, key=len, reverse=True)) + ") "
    recoded = keep_in(pairs, complete_ids, "accession").withColumn("category", F.regexp_replace("category", pattern, " feature "))
    wide = to_wide(recoded, ["accession", "feature"], "category", "value", list(names)).withColumnRenamed("accession", "sample")
    tidy = snake_columns(wide)
    return clean_counts(tidy, ["sample", "feature"], [c for c in COUNT_COLUMNS if c in tidy.columns])


def gap_report(files: DataFrame, metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Datasets per feature: on file, without metadata, without results, duplicated."""
    listed = files.groupBy("feature", "accession").agg(F.count(F.lit(1)).alias("n"))
    meta = metadata.select("accession").distinct().withColumn("_meta", F.lit(True))
    done = results.select("feature", "accession").distinct().withColumn("_done", F.lit(True))
    marked = listed.join(done, ["feature", "accession"], "left").join(meta, "accession", "left")
    return marked.groupBy("feature").agg(
        F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_datasets"),
        F.count_if(F.col("_meta").isNull()).alias("n_without_metadata"),
        F.count_if(F.col("_done").isNull()).alias("n_without_results"), F.count_if(F.col("n") > 1).alias("n_duplicated"),
    )


def without_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return drop_in(files, metadata.select("accession").distinct(), "accession")


def last_lookup(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key; the last by `order` wins."""
    return first_row(rows, [key], order, last=True)


def metadata_rows(ids: DataFrame, **values: str) -> DataFrame:
    """One row of constant metadata for each distinct id."""
    return ids.distinct().withColumns({k: F.lit(v) for k, v in values.items()})
