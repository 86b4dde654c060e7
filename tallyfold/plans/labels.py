"""Label resolution: diseases, tissues, sample names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import HEALTHY_WORDS, capture, first_clean_label, has_keyword, split_tags
from ..operators.aggregate import frequent
from ..operators.joins import drop_in, first_row, spread_first
from ..operators.windows import head

# Names of the ten disease clusters, then the one for healthy donors.
CLUSTER_NAMES = {
    0: "Cancer and Neoplasms",
    1: "Genetic Disease Susceptibilities",
    2: "Infectious Diseases",
    3: "Physical Injuries and Trauma",
    4: "Veterinary and Animal Diseases",
    5: "Neurological and Neurodegenerative Diseases",
    6: "Developmental and Immunodeficiency Disorders",
    7: "Metabolic and Diabetes-Related Diseases",
    8: "Cardiovascular Diseases",
    9: "Inflammatory and Respiratory Diseases",
}
HEALTHY_ID, HEALTHY_NAME = 10, "Healthy"


def cluster_names(spark) -> DataFrame:
    return spark.createDataFrame(list(CLUSTER_NAMES.items()), "cluster_id int, cluster_name string")


def term_abundance(terms: DataFrame, ids: str, separator: str = ";") -> DataFrame:
    """`(node, abundance)`: how often each id occurs in the delimited column."""
    parts = terms.where(F.col(ids).isNotNull()).select(F.explode(split_tags(ids, separator, "")).alias("node"))
    return frequent(parts.where("node <> ''"), ["node"], name="abundance")


def resolve_labels(datasets: DataFrame, terms: DataFrame, clusters: DataFrame, names: DataFrame,
                   healthy: Sequence[str] = HEALTHY_WORDS, whole_word: bool = False) -> DataFrame:
    """Cluster of each dataset's disease, one row per dataset and distinct id of the disease.

    `terms` is `(disease, ids)` with `;` between ids, `clusters` `(node_id,
    cluster_id)`. Free text with a healthy word overrides the cluster; datasets
    that resolve to nothing are left out. `multi_id` marks diseases with several ids.
    """
    parts = split_tags("ids", ";", "")
    exploded = (
        terms.withColumn("multi_id", F.size(parts) > 1)
        .select("disease", "multi_id", F.explode(parts).alias("node_id")).distinct()
    )
    resolved = exploded.join(clusters.join(names, "cluster_id"), "node_id")
    sick = datasets.join(resolved, "disease", "left")
    override = has_keyword("disease", healthy, whole_word)
    return (
        sick.withColumn("cluster_id", F.when(override, F.lit(HEALTHY_ID)).otherwise(F.col("cluster_id")))
        .withColumn("cluster_name", F.when(override, F.lit(HEALTHY_NAME)).otherwise(F.col("cluster_name")))
        .where(F.col("cluster_id").isNotNull())
        .select(datasets.columns + ["node_id", "multi_id", "cluster_id", "cluster_name"])
    )


def tag_counts(df: DataFrame, tags: str, labels: DataFrame, top_n: int = 30, separator: str = ",") -> DataFrame:
    """The most frequent tags of a delimited column with their labels; `labels` is `(tag, label)`."""
    counts = frequent(df.select(F.explode(split_tags(tags, separator)).alias("tag")), ["tag"], name="n")
    top = head(counts, [F.desc("n"), "tag"], top_n)
    return top.join(labels, "tag", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def refresh_taxonomy(current: DataFrame, incoming: DataFrame, label: str = "tissue") -> DataFrame:
    """Categories with the incoming ones put over the current ones, cleaned, one row per label."""
    old = first_row(current.select(label, "category"), [label], ["category"])
    new = first_row(incoming.select(label, F.col("category").alias("_new")), [label], ["_new"])
    return old.join(new, label, "left").select(label, first_clean_label("_new", "category").alias("category"))


def unmapped_labels(df: DataFrame, taxonomy: DataFrame, label: str, by: str) -> DataFrame:
    """Labels without a category and how many each group has."""
    pairs = df.select(by, label).where(F.col(label).isNotNull()).distinct()
    return frequent(drop_in(pairs, taxonomy.select(label), label), [by], name="n_unmapped")


def sample_sheet(runs: DataFrame, name_pattern: str = r"^(.+)_(L[0-9]+)$", must_contain: str = "mRNA",
                 organism: str = "Homo sapiens") -> DataFrame:
    """Sequencing sheet `(sample, accession, name, lane, organism)`.

    `runs` is `(name, experiment, run)`. Names without a lane or without the
    required text are left out; all lanes of a name get its first experiment.
    """
    parsed = runs.where(F.col("name").contains(must_contain)).select(
        capture("name", name_pattern, 1).alias("name"), capture("name", name_pattern, 2).alias("lane"),
        F.col("experiment").alias("sample"), F.col("run").alias("accession"),
    ).where(F.col("lane").isNotNull() & F.col("name").contains(must_contain))
    merged = spread_first(parsed, ["name"], "sample", ["sample"])
    return merged.withColumn("organism", F.lit(organism)).select("sample", "accession", "name", "lane", "organism")


def missing_samples(sheet: DataFrame, finished: DataFrame) -> DataFrame:
    return drop_in(sheet, finished.select("sample").distinct(), "sample")
