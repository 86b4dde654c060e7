"""Cell by gene counts in long format: `(cell_id, gene_id, count)`, non-zero rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import ratio
from ..functions.text import UNTYPED_WORDS, nullify
from ..session import materialize
from .joins import all_combinations, composed_key
from .ranked import global_quantile
from .significance import adjusted_p, t_p_value
from .windows import first_n

# A cell passes with more genes and more molecules than these, a
# dataset with at least so many passing cells.
MIN_GENES, MIN_UMIS, MIN_CELLS = 300, 500, 500


def cell_totals(counts: DataFrame) -> DataFrame:
    """Molecules and detected genes per cell."""
    return counts.where("count > 0").groupBy("cell_id").agg(
        F.sum("count").alias("umi_count"), F.count(F.lit(1)).alias("gene_count"))


def passing_cells(cells: DataFrame, min_genes: float = MIN_GENES, min_umis: float = MIN_UMIS) -> DataFrame:
    return cells.where((F.col("gene_count") > min_genes) & (F.col("umi_count") > min_umis))


def dataset_gate(cells: DataFrame, dataset: Sequence[str], min_genes: float = MIN_GENES,
                 min_umis: float = MIN_UMIS, min_cells: int = MIN_CELLS) -> DataFrame:
    """Size of each dataset after the cell filter and whether it passes."""
    sizes = passing_cells(cells, min_genes, min_umis).groupBy(*dataset).agg(F.count(F.lit(1)).alias("n_cells"))
    return sizes.withColumn("passes", F.col("n_cells") >= min_cells)


def gated_cells(cells: DataFrame, dataset: Sequence[str], **limits: float) -> DataFrame:
    """Passing cells of passing datasets."""
    keep = dataset_gate(cells, dataset, **limits).where("passes")
    own = {k: v for k, v in limits.items() if k != "min_cells"}
    return passing_cells(cells, **own).join(keep, list(dataset), "left_semi")


def retained_fractions(cells: DataFrame, dataset: Sequence[str], min_genes: float = MIN_GENES,
                       min_umis: float = MIN_UMIS, min_cells: int = MIN_CELLS) -> DataFrame:
    """One row: share of datasets that pass and share of all cells that stay."""
    good = (F.col("gene_count") > min_genes) & (F.col("umi_count") > min_umis)
    sizes = cells.groupBy(*dataset).agg(F.count(F.lit(1)).alias("_all"), F.count_if(good).alias("_n"))
    passes = F.col("_n") >= min_cells
    return sizes.agg(
        F.count_if(F.col("_n") > 0).alias("n_datasets"), F.count_if(passes & (F.col("_n") > 0)).alias("n_passing"),
        F.coalesce(F.sum(F.when(passes, F.col("_n"))), F.lit(0)).alias("n_cells"), F.sum("_all").alias("_cells"),
    ).select(
        "n_datasets", "n_passing", "n_cells",
        ratio("n_passing", "n_datasets").alias("datasets_kept"), ratio("n_cells", "_cells").alias("cells_kept"),
    )


def normalize_counts(counts: DataFrame, target: float | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Counts scaled so that each cell sums to the target, by default the median total.

    `totals` may bring `(cell_id, umi_count)` along with further cell columns,
    which are kept; cells it lacks are left out. The totals, one row per cell, are
    written out, as both the median and the scaling need them.
    """
    if totals is None:
        totals = materialize(cell_totals(counts).select("cell_id", "umi_count"), "totals")
    goal = F.lit(float(target)) if target is not None else global_quantile(totals, "umi_count", 0.5)
    return counts.where("count > 0").join(totals, "cell_id").withColumn(
        "value", F.col("count") * goal / F.col("umi_count")).drop("umi_count")


def log_values(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("value", F.log1p("value"))


def drop_rare_types(cells: DataFrame, group: str, at_least: int = 2) -> DataFrame:
    """Cells of groups with enough cells; cells without a group are dropped."""
    sizes = cells.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return cells.join(sizes, group, "left_semi")


def clean_types(cells: DataFrame, label: str) -> DataFrame:
    """Cells with a real type label."""
    return cells.withColumn(label, nullify(label, UNTYPED_WORDS)).where(F.col(label).isNotNull())


def rank_genes(counts: DataFrame, cells: DataFrame, group: str, top_n: int | None = None,
               p_values: bool = False) -> DataFrame:
    """Genes of each group scored against all other cells.

    Welch's t on log-normalised counts, computed from sums over the non-zero
    rows; zeros enter through the group sizes. A score is null where neither
    side varies. `log_fold_change` is base 2. With `p_values`, two-sided p-values
    and those adjusted over all genes of the group; a null score has p-value 1.
    """
    sizes = materialize(
        cells.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n1")).where("n1 > 1"), "sizes")
    typed = cells.select("cell_id", group).join(sizes, group, "left_semi")
    # the counts are read twice: for the cell totals and for the sums per group and gene
    totals = materialize(cell_totals(counts).select("cell_id", "umi_count").join(typed, "cell_id"), "totals")
    values = log_values(normalize_counts(counts, totals=totals))
    sums = materialize(values.groupBy(group, "gene_id").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")), "sums")
    genes = sums.groupBy("gene_id").agg(F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    n_all = sizes.agg(F.sum("n1").alias("n")).scalar()
    spread1, spread2 = F.col("v1") / F.col("n1"), ratio("v2", "n2")
    freedom = ratio((spread1 + spread2) ** 2, spread1**2 / (F.col("n1") - 1) + ratio(spread2**2, F.col("n2") - 1))
    full = all_combinations(genes, sizes).join(sums, [group, "gene_id"], "left").fillna({"s": 0.0, "ss": 0.0})
    n1, n2 = F.col("n1"), F.col("n2")
    m1, m2 = F.col("m1"), F.col("m2")
    scored = (
        full.withColumn("n2", n_all - F.col("n1"))
        .withColumn("m1", F.col("s") / n1)
        .withColumn("m2", ratio(F.col("all_s") - F.col("s"), n2))
        .withColumn("v1", F.greatest(F.lit(0.0), ratio(F.col("ss") - n1 * m1 * m1, n1 - 1)))
        .withColumn("v2", F.greatest(F.lit(0.0), ratio(F.col("all_ss") - F.col("ss") - n2 * m2 * m2, n2 - 1)))
        .withColumn("score", ratio(m1 - m2, F.sqrt(F.col("v1") / n1 + ratio("v2", "n2"))))
        .withColumn("log_fold_change", F.log2((F.expm1("m1") + 1e-9) / (F.expm1("m2") + 1e-9)))
        .select(F.col(group).alias("group"), F.col("gene_id").alias("gene"), "score", "log_fold_change",
                F.col("m1").alias("mean_group"), F.col("m2").alias("mean_rest"),
                *[t_p_value(F.col("score"), freedom).alias("p")] * p_values)
    )
    if p_values:
        scored = adjusted_p(scored, ["group"], ["gene"])
    return top_genes(scored, top_n) if top_n else scored


def top_genes(scored: DataFrame, n: int) -> DataFrame:
    """The n best genes per group by score."""
    return first_n(scored.where("score is not null"), ["group"], [F.desc("score"), F.col("gene")], n, "rank")


def average_over(table: DataFrame, axis: str, values: Sequence[str]) -> DataFrame:
    """Mean of each value along the other axis, missing cells skipped."""
    return table.groupBy(axis).agg(*[F.avg(v).alias(v) for v in values])


def combine_datasets(tables: Sequence[DataFrame], dataset: str = "dataset", cell: str = "cell") -> DataFrame:
    """Several datasets as one, columns they share only, with unique cell ids."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    out = tables[0].select(shared)
    for t in tables[1:]:
        out = out.unionByName(t.select(shared))
    return out.withColumn("cell_id", composed_key([dataset, cell]))


def align_cells(embeddings: DataFrame, types: DataFrame, totals: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells present in all three tables."""
    return embeddings.join(types, key).join(totals, key)


def coverage(embeddings: DataFrame, aligned: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row: aligned cells as a share of the embedded ones."""
    have = aligned.select(key).distinct().withColumn("_hit", F.lit(1))
    return embeddings.select(key).join(have, key, "left").agg(
        F.count(F.lit(1)).alias("n_embedded"), F.count("_hit").alias("n_aligned"),
    ).withColumn("coverage", ratio("n_aligned", "n_embedded"))
