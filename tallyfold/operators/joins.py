"""Joins with the null, default and duplicate rules of the catalogue work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, scratch_path, write_measured

# Rows of a product that one task makes.
PRODUCT_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on which a null key matches a null key; keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def lookup_join(df: DataFrame, table: DataFrame, on: str | Sequence[str],
                defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join to a lookup with one row per key; `defaults` fill the misses."""
    out = df.join(table, on, "left")
    return out.fillna(dict(defaults)) if defaults else out


def recode(df: DataFrame, column: str, mapping: DataFrame, mode: str = "map",
           default: str | None = None) -> DataFrame:
    """Recode a column with a mapping table `(old, new)`.

    `map` turns unmapped values into `default`; `replace` keeps them.
    """
    if mode not in ("map", "replace"):
        raise ValueError("mode is map or replace")
    old, new = mapping.columns
    table = mapping.select(F.col(old).alias(column), F.col(new).alias("_new"))
    rest = F.col(column) if mode == "replace" else F.lit(default)
    return (
        df.join(table, column, "left")
        .withColumn(column, F.coalesce("_new", rest))
        .select(df.columns)
    )


def keep_in(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in `ids`."""
    return df.join(ids, on, "left_semi")


def drop_in(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in `ids`; rows with a null key stay."""
    return df.join(ids, on, "left_anti")


def unambiguous_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                     suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join of two sources that share column names besides the keys."""
    shared = set(left.columns) & set(right.columns) - set(on)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, list(on), how)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
              last: bool = False) -> DataFrame:
    """One row per key, first (or last) by `order`; ties fall back on the whole row.

    A struct minimum combines on the map side, so a key with very many copies
    never reaches one task as rows.
    """
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cols)], *rest)
    pick = F.max(ranked) if last else F.min(ranked)
    picked = df.groupBy(*keys).agg(pick.alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def drop_duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the rows whose key occurs once."""
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*(rest or keys))).alias("_row"))
    return packed.where("_n = 1").select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def flag_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """True on every row of a key but its first by `order` (unique within the key)."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        null_safe_join(df, firsts, keys, "inner")
        .withColumn(name, F.struct(*order) > F.col("_first"))
        .drop("_first")
    )


def spread_first(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """Overwrite `column` with the value its group's first row has."""
    firsts = df.groupBy(*keys).agg(F.min_by(column, F.struct(*order)).alias("_first"))
    return (
        null_safe_join(df, firsts, keys, "inner").withColumn(column, F.col("_first")).drop("_first")
    )


def all_combinations(left: DataFrame, right: DataFrame, slots: int | None = None) -> DataFrame:
    """Every row of `left` with every row of `right`, as an equi-join on slots.

    Both sides are written out and counted. The rows of the larger side are
    spread over the slots and those of the smaller one repeated in each; without
    `slots` there are as many as it takes for about `PRODUCT_ROWS` rows in each.
    """
    sides, rows = [], []
    for df in (left, right):
        path = scratch_path(df.sparkSession, "side")
        rows.append(write_measured(df, path, n=F.count(F.lit(1)))["n"])
        sides.append(df.sparkSession.read.schema(df.schema).parquet(path))
    slots = slots or max(1, min(max(rows), -(-rows[0] * rows[1] // PRODUCT_ROWS)))
    large, small = sides if rows[0] >= rows[1] else reversed(sides)
    spread = large.withColumn("_slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
    repeated = small.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return spread.join(repeated, "_slot").select(*left.columns, *right.columns)


def id_gap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each id once, with `both`, `left` or `right` for where it occurs."""
    sides = left.select(key).withColumn("_side", F.lit(1)).unionByName(
        right.select(key).withColumn("_side", F.lit(2)))
    return sides.groupBy(key).agg(
        F.when(F.min("_side") != F.max("_side"), "both").when(F.max("_side") == 1, "left")
        .otherwise("right").alias("found_in")
    )


def term_differences(left: DataFrame, right: DataFrame, by: str, term: str) -> DataFrame:
    """Many-to-many comparison of two annotations of the same collections.

    For each collection on both sides and each term: the rows that use it left
    and right, and how many left/right row pairs involve it and differ. Pairs
    are counted from the totals, never written out.
    """
    counts = (
        left.select(by, term, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(by, term, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .where(F.col(by).isNotNull())
        .groupBy(by, term)
        .agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    )
    counts = materialize(counts, "counts")
    totals = counts.groupBy(by).agg(F.sum("left_rows").alias("_l"), F.sum("right_rows").alias("_r"))
    return counts.join(totals.where("_l > 0 and _r > 0"), by).select(
        by, term, "left_rows", "right_rows",
        (F.col("left_rows") * (F.col("_r") - F.col("right_rows"))).alias("differing_pairs"),
    )


def composed_key(parts: Sequence[Column | str], name: str = "cell_key", separator: str = "_") -> Column:
    """Parts joined by a separator, null if any part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    out = []
    for i, c in enumerate(cols):
        out += [F.lit(separator)] if i else []
        out.append(c.cast("string"))
    return F.concat(*out).alias(name)
