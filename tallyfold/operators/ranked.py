"""Distributed order statistics: running weights, ranks, quantiles.

A window over one big group would sort that group in a single task. Here rows
are cut into ranges of the order first; a window then runs within each (group,
range) and the small table of range totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize, scratch_path, write_measured

# Items a quantile sketch keeps, the error of its ranks (99 % of them), and the slack allowed for it.
SKETCH_SIZE, RANK_ERROR = 4096, 0.0013
RANK_SLACK = 3 * RANK_ERROR
# Groups of up to so many rows are ordered whole.
FEW_ROWS = 1024
# Rows of a range within which a window runs.
ROWS_PER_RANGE = 500_000


def running_weight(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                   weight: str | None = None) -> DataFrame:
    """Adds `_before`, the weight of the rows that come earlier in their group, and `_total`, that of all.

    `order` must be unique within a group. Without `weight` each row counts 1,
    so `_before` is the zero-based rank and `_total` the number of rows. The
    input is executed once and written; counting and cutting it into ranges read that.
    """
    by, order = list(by), list(order)
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    path = scratch_path(df.sparkSession, "weighed")
    n = write_measured(df, path, n=F.count(F.lit(1)))["n"]
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    rows = materialize(
        df.repartitionByRange(parts, *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_amount", amount),
        "ranges",
    )
    # one row per (group, range): at most `parts` of them in a group
    totals = rows.groupBy(*by, "_range").agg(F.sum("_amount").alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy(*by)).alias("_total"))
    keyed = [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    joined = rows.alias("r").join(
        offsets.alias("o"), [F.col("r._range") == F.col("o._range"), *keyed], "inner"
    ).select("r.*", "o._offset", "o._total")
    within = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_amount").over(within), F.lit(0))
    ).drop("_range", "_amount", "_offset")


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Global one-based row number over a unique order."""
    return running_weight(df, order).withColumn(name, F.col("_before") + 1).drop("_before", "_total")


def label_ranks(df: DataFrame, label: str, value: str, name: str = "label_rank") -> DataFrame:
    """Labels ranked by their total, largest first; ties by label."""
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(value).alias("total"))
    ranked = row_numbers(totals.withColumn("_down", -F.col("total")), ["_down", label], name)
    return ranked.drop("_down")


def batches(ids: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Consecutive batches of `size` rows of the sorted rows, numbered from 0."""
    return running_weight(ids, order).withColumn(
        "batch_id", F.floor(F.col("_before") / size)
    ).drop("_before", "_total")


def empirical_cdf(df: DataFrame, value: str, name: str = "fraction") -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_weight(counts, [value], weight="n")
    return ranked.select(value, "n", ((F.col("_before") + F.col("n")) / F.col("_total")).alias(name))


def budget_sample(df: DataFrame, strata: Sequence[str], id_col: str, size: str, budget: float,
                  seed: int = 42) -> DataFrame:
    """Datasets of each stratum in seeded random order until their sizes reach the budget.

    The dataset that crosses the budget is still taken. The order is that of a hash
    of seed and id, so it does not depend on partitions.
    """
    shuffled = df.withColumn("_shuffle", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    ranked = running_weight(shuffled, ["_shuffle", id_col], by=strata, weight=size)
    return ranked.where(F.col("_before") < budget).drop("_before", "_total", "_shuffle")


def _positions(q: float, method: str, total: Column) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and the share of the upper one."""
    at = (total - 1) * F.lit(float(q))
    if method == "nearest":
        rank = F.round(at).cast("long")
        return rank, rank, F.lit(0.0)
    low = F.floor(at)
    return low, F.ceil(at), at - low


def _bracket(sketch: Column, n: Column, q: float) -> tuple[Column, Column]:
    """Two values between which the rank of `q` lies; open ends near the extremes and in small groups."""
    ends = []
    for rank, open_end in ((q - RANK_SLACK, float("-inf")), (q + RANK_SLACK, float("inf"))):
        if 0 < rank < 1:
            ends.append(F.when(n > FEW_ROWS, F.kll_sketch_get_quantile_double(sketch, F.lit(rank))).otherwise(F.lit(open_end)))
        else:
            ends.append(F.lit(open_end))
    return ends[0], ends[1]


def column_quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, Mapping[str, float]],
                     method: str = "linear", also: Sequence[Column] = ()) -> DataFrame:
    """Exact quantiles of several columns per group, `wanted` giving `{column: {name: q}}`.

    `linear` interpolates, `nearest` picks a row. Missing values, NaN included,
    do not count; a column of a group without values gives nulls. `also` are
    further aggregates per group, taken in the same pass.

    The table is read twice, whatever the number of columns. The first pass
    makes a mergeable sketch per group and column, whose ranks bracket each
    wanted value. The second counts the values inside the brackets one by one and
    all between two brackets together, so what is left to order is a share of
    about `6 * RANK_ERROR` per quantile. Should a bracket miss its rank, which the
    slack makes next to impossible, that group alone is counted in full.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method is linear or nearest")
    by, names = list(by), list(wanted)
    amounts = {}
    for i, c in enumerate(names):
        amount = F.col(c).cast("double")
        amounts[f"_v{i}"] = F.when(~F.isnan(amount), amount)
    values = df.select("*", *[c.alias(n) for n, c in amounts.items()])
    sketches = values.groupBy(*by).agg(
        *[F.kll_sketch_agg_double(f"_v{i}", F.lit(SKETCH_SIZE)).alias(f"_s{i}") for i in range(len(names))],
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))], *also)
    extra = sketches.columns[len(by) + 2 * len(names):]
    ends = []
    for i, c in enumerate(names):
        for j, q in enumerate(wanted[c].values()):
            lo, hi = _bracket(F.col(f"_s{i}"), F.col(f"_n{i}"), float(q))
            ends += [lo.alias(f"_lo{i}_{j}"), hi.alias(f"_hi{i}_{j}")]
    brackets = materialize(sketches.select(*by, *[f"_n{i}" for i in range(len(names))], *ends, *extra), "brackets")
    narrow = values.select(*by, *amounts)
    picks, missed = _pick(narrow, by, brackets, wanted, method)
    if missed:
        lost = picks.where("_missed").select(*by)
        widened = [c for c in brackets.columns if c.startswith(("_lo", "_hi"))]
        whole = brackets.withColumns({c: F.lit(float("-inf" if c.startswith("_lo") else "inf")) for c in widened})
        if by:
            keyed = [F.col(f"b.{k}").eqNullSafe(F.col(f"x.{k}")) for k in by]
            whole = whole.alias("b").join(lost.alias("x"), keyed, "left_semi")
        again, _ = _pick(narrow, by, whole, wanted, method)
        picks = picks.where("not _missed").unionByName(again)
    outputs = [n for c in names for n in wanted[c]]
    if not by:
        one = picks.select(F.struct(*outputs)).scalar()
        return brackets.select(*extra, *[one[n].alias(n) for n in outputs])
    found = brackets.select(*by, *extra).alias("b").join(
        picks.alias("p"), [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by], "left" if extra else "inner")
    return found.select(*[f"b.{k}" for k in by], *[f"b.{c}" for c in extra], *[f"p.{n}" for n in outputs])


def _in_or_between(value: Column, ends: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The value itself inside a bracket, else the end of the last bracket below it; and whether it is outside.

    Order is kept: what lies between two brackets becomes one value, placed between theirs.
    """
    inside = F.lit(False)
    for lo, hi in ends:
        inside = inside | ((lo <= value) & (value <= hi))
    below = F.greatest(*[F.when(hi < value, hi) for _, hi in ends], F.lit(None).cast("double"))
    return F.when(inside, value).otherwise(below), ~inside


def _pick(values: DataFrame, by: list[str], brackets: DataFrame, wanted: Mapping[str, Mapping[str, float]],
          method: str) -> tuple[DataFrame, int]:
    """The quantiles of the groups in `brackets`, written, and in how many groups a bracket missed its rank."""
    ends = [c for c in brackets.columns if c.startswith(("_lo", "_hi"))]
    if by:
        keyed = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
        rows = values.alias("v").join(brackets.select(*by, *ends).alias("b"), keyed).select("v.*", *[f"b.{c}" for c in ends])
    else:
        bounds = brackets.select(F.struct(*ends)).scalar()
        rows = values.select("*", *[bounds[c].alias(c) for c in ends])
    columns = []
    for i, c in enumerate(wanted):
        value, outside = _in_or_between(F.col(f"_v{i}"), [(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")) for j in range(len(wanted[c]))])
        columns.append(F.struct(F.lit(i).alias("_column"), F.col(f"_v{i}").isNotNull().alias("_known"), value.alias("_value"), outside.alias("_outside")))
    counted = (
        rows.select(*by, F.inline(F.array(*columns))).where("_known")
        .groupBy(*by, "_column", "_value", "_outside").agg(F.count(F.lit(1)).alias("_n"))
    )
    path = scratch_path(values.sparkSession, "near-ranks")
    size = write_measured(counted, path, n=F.count(F.lit(1)))["n"]
    counted = values.sparkSession.read.schema(counted.schema).parquet(path)
    keys, order = [*by, "_column"], ["_value", "_outside"]
    if size <= ROWS_PER_RANGE:  # one task may hold them all
        ordered = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        placed = counted.withColumns({
            "_before": F.coalesce(F.sum("_n").over(ordered), F.lit(0)), "_total": F.sum("_n").over(W.partitionBy(*keys))})
    else:
        placed = running_weight(counted, order, by=keys, weight="_n")
    first, last = F.col("_before"), F.col("_before") + F.col("_n")
    picks, out, missed = [], [], F.lit(False)
    for i, quantiles in enumerate(wanted.values()):
        for j, q in enumerate(quantiles.values()):
            low, high, share = _positions(q, method, F.col("_total"))
            own = F.col("_column") == i
            for side, rank in (("a", low), ("z", high)):
                hit = own & (first <= rank) & (rank < last)
                picks.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{side}{i}_{j}"))
                missed = missed | (hit & F.col("_outside"))
            picks.append(F.max(F.when(own, share)).alias(f"_share{i}_{j}"))
    found = placed.groupBy(*by).agg(*picks, F.coalesce(F.bool_or(missed), F.lit(False)).alias("_missed"))
    for i, quantiles in enumerate(wanted.values()):
        for j, name in enumerate(quantiles):
            lo, hi = F.col(f"_a{i}_{j}"), F.col(f"_z{i}_{j}")
            step = F.when(lo != hi, (hi - lo) * F.col(f"_share{i}_{j}")).otherwise(0.0)
            out.append((lo + step).alias(name))
    done = found.select(*by, *out, "_missed")
    path = scratch_path(values.sparkSession, "quantiles")
    misses = write_measured(done, path, n=F.count_if("_missed"))["n"]
    return values.sparkSession.read.schema(done.schema).parquet(path), misses


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float],
                    method: str = "linear") -> DataFrame:
    """Quantiles of one column per group, see `column_quantiles`; `approx` is Spark's approximation.

    Groups without a value have no row.
    """
    if method == "approx":
        return df.groupBy(*by).agg(
            *[F.percentile_approx(value, q).cast("double").alias(name) for name, q in quantiles.items()]
        )
    return column_quantiles(df, by, {value: quantiles}, method)


def group_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return group_quantiles(df, by, value, {name: 0.5})


def global_quantile(df: DataFrame, value: str, q: float) -> Column:
    """One quantile of a whole column, as a scalar to use in other expressions."""
    return group_quantiles(df, [], value, {"q": q}).scalar()
