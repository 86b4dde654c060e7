"""Text columns: missing values, labels, paths, sizes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words that stand for "no disease given".
NO_VALUE_WORDS = (
    "unsure", "not specified", "none", "none reported", "other", "none specified",
    "not applicable", "none indicated",
)

# Cell-type labels that carry no type.
UNTYPED_WORDS = ("nan", "unknown", "other")

# Words that mark a healthy donor in free text.
HEALTHY_WORDS = (
    "healthy", "normal", "control", "wild-type", "wild type", "wildtype", "none",
    "not reported", "not specified",
)

# Units of 1024 used in size texts.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify(c: Column | str, words: Sequence[str] = ()) -> Column:
    """Null for blank text and, ignoring case, for any of `words`."""
    c = _col(c)
    gone = F.trim(c) == ""
    if words:
        gone = gone | F.lower(F.trim(c)).isin([w.lower() for w in words])
    return F.when(~gone, c)


def truncate_text(c: Column | str, limit: int, total: bool = False) -> Column:
    """Long text cut and marked with `...`.

    `total=True` keeps the result within `limit`; otherwise the mark comes on
    top of `limit` kept characters.
    """
    c = _col(c)
    kept = limit - 3 if total else limit
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, kept), F.lit("..."))).otherwise(c)


def first_clean_label(preferred: Column | str, fallback: Column | str) -> Column:
    """First of two labels, unquoted, trimmed, lower case, up to the first `;`."""
    text = F.coalesce(_col(preferred), _col(fallback))
    text = F.lower(F.trim(F.replace(text, F.lit('"'), F.lit(""))))
    return F.split(text, ";").getItem(0)


def has_keyword(c: Column | str, words: Sequence[str], whole_word: bool = False) -> Column:
    """Does the text hold any of `words`, ignoring case; null text holds none."""
    pattern = "|".join(re.escape(w.lower()) for w in words)
    if whole_word:
        pattern = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:$|[^\p{{L}}\p{{N}}_])"
    return F.coalesce(F.lower(_col(c)).rlike(pattern), F.lit(False))


def map_label(c: Column | str, mapping: Mapping[str, str], keep_unmapped: bool = False) -> Column:
    """Recode with a small fixed mapping; unmapped labels become null or stay."""
    c = _col(c)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    mapped = F.element_at(F.create_map(*pairs), c)
    return F.coalesce(mapped, c) if keep_unmapped else mapped


def capture(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A capture group, or null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def stand_in_id(c: Column | str, strip: str = "ARC", prefix: str = "1") -> Column:
    """`prefix` plus the id without its leading characters out of `strip`."""
    return F.concat(F.lit(prefix), F.ltrim(_col(c), F.lit(strip)))


def replace_literal(c: Column | str, old: str, new: str) -> Column:
    return F.replace(_col(c), F.lit(old), F.lit(new))


def path_part(c: Column | str, position: int) -> Column:
    """Part of a `/` path; negative positions count from the end."""
    return F.element_at(F.split(_col(c), "/"), position)


def path_part_starting(c: Column | str, prefix: str) -> Column:
    """First path part that starts with `prefix`; `key=` in front is ignored."""
    found = F.regexp_extract(_col(c), rf"(?:^|/)(?:[^/=]+=)?({re.escape(prefix)}[^/]*)(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def split_tags(c: Column | str, separator: str = ",", blank: str = "unknown") -> Column:
    """Array of trimmed parts of a delimited text; blank parts become `blank`."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), re.escape(separator))
    return F.transform(parts, lambda p: F.when(F.trim(p) == "", F.lit(blank)).otherwise(F.trim(p)))


def size_text(c: Column | str) -> Column:
    """Bytes as text with two decimals and a 1024-based unit."""
    c = _col(c).cast("double")
    text = None
    for power, unit in enumerate(SIZE_UNITS):
        shown = F.format_string(f"%.2f {unit}", c / F.lit(float(1024 ** power)))
        fits = c < F.lit(float(1024 ** (power + 1)))
        last = power == len(SIZE_UNITS) - 1
        text = F.when(c == 0, F.lit("0B")) if text is None else text
        text = text.otherwise(shown) if last else text.when(fits, shown)
    return text


def percent_text(c: Column | str, digits: int = 2) -> Column:
    """A ratio as a percentage, e.g. `12.34%`."""
    return F.format_string(f"%.{digits}f%%", _col(c) * 100)


def snake_columns(df: DataFrame) -> DataFrame:
    """Column names with every non-word character as `_`, in lower case."""
    return df.toDF(*[re.sub(r"\W", "_", name).lower() for name in df.columns])
