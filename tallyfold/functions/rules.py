"""Rules that turn labels into categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Library technologies that keep their own label.
MAIN_TECHNOLOGIES = ("3_prime_gex", "5_prime_gex", "multiome", "vdj", "feature_barcoding", "cellplex")

# Ordered fine-grained rules, (category found, label given).
FINE_CELL_RULES = (
    ("monocyte", "monocyte"),
    ("stem cell", "progenitor/stem cell"),
    ("progenitor cell", "progenitor/stem cell"),
    ("fibroblast", "fibroblast"),
    ("connective tissue cell", "other connective tissue cell"),
    ("T cell", "T cell"),
    ("B cell", "B cell"),
    ("neutrophil", "neutrophil"),
    ("macrophage", "macrophage"),
    ("plasma cell", "plasma cell"),
    ("natural killer cell", "natural killer cell"),
    ("leukocyte", "other leukocyte"),
    ("platelet", "platelet"),
    ("erythrocyte", "erythrocyte"),
    ("hematopoietic cell", "other hematopoietic cell"),
)

# Top-level rules.
TOP_CELL_RULES = (("stem cell", "progenitor/stem cell"), ("progenitor cell", "progenitor/stem cell"))

# Words in a tool name and the kind of tool they show, first hit wins.
TOOL_KIND_RULES = (
    (("workflow",), "workflow"),
    (("agent",), "agent"),
    (("fetch", "get", "query"), "fetch"),
    (("esearch", "efetch", "esummary", "elink"), "entrez"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_or_other(c: Column | str, keep: Sequence[str], other: str = "other") -> Column:
    """The label if it is in `keep`; anything else, null included, is `other`."""
    c = _col(c)
    return F.when(c.isin(list(keep)), c).otherwise(F.lit(other))


def first_rule(rules: Sequence[tuple[Column, str]], default: Column | str | None) -> Column:
    """Label of the first condition that holds."""
    out = F
    for condition, label in rules:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default) if isinstance(default, str) or default is None else default)


def category_from_array(found: Column | str, rules: Sequence[tuple[str, str]],
                        default: Column | str | None) -> Column:
    """First rule whose category is in the array of found categories."""
    return first_rule([(F.array_contains(_col(found), cat), label) for cat, label in rules], default)


def category_from_text(text: Column | str, rules: Sequence[tuple[Sequence[str], str]],
                       default: Column | str | None) -> Column:
    """First rule with a word that the text contains (case kept)."""
    conditions = []
    for words, label in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.coalesce(_col(text).contains(word), F.lit(False))
        conditions.append((hit, label))
    return first_rule(conditions, default)


def facet(c: Column | str, major: Sequence[str], names: tuple[str, str] = ("major", "minor")) -> Column:
    """Which of two panels a label belongs to."""
    return F.when(_col(c).isin(list(major)), F.lit(names[0])).otherwise(F.lit(names[1]))
