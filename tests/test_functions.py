"""Scalar expressions on hand-written rows."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import dates, numeric, rules, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("ARC00012", "100012"), ("CARX", "1X"), ("CRA", "1"), ("X1", "1X1"), (None, None)])
def test_stand_in_id(spark, value, expected):
    assert one(spark, text.stand_in_id("c"), c=("string", value)) == expected


@pytest.mark.parametrize("new, old, expected", [
    ('"Root";stem', "Leaf", "root"), (None, " Leaf ", "leaf"), (None, None, None), ('a ;b', "x", "a ")])
def test_first_clean_label(spark, new, old, expected):
    assert one(spark, text.first_clean_label("n", "o"), n=("string", new), o=("string", old)) == expected


@pytest.mark.parametrize("value, expected", [
    ("", None), ("  ", None), ("Unsure", None), ("not specified", None), ("asthma", "asthma"), (None, None)])
def test_nullify(spark, value, expected):
    assert one(spark, text.nullify("c", text.NO_VALUE_WORDS), c=("string", value)) == expected


def test_truncate_text(spark):
    assert one(spark, text.truncate_text("c", 5), c=("string", "abcdefgh")) == "abcde..."
    assert one(spark, text.truncate_text("c", 5, total=True), c=("string", "abcdefgh")) == "ab..."
    assert one(spark, text.truncate_text("c", 5), c=("string", "abcde")) == "abcde"


@pytest.mark.parametrize("value, whole, expected", [
    ("abnormal growth", False, True), ("abnormal growth", True, False), ("Normal tissue", True, True),
    ("wild-type", True, True), ("tumour", False, False), (None, False, False)])
def test_has_keyword(spark, value, whole, expected):
    assert one(spark, text.has_keyword("c", text.HEALTHY_WORDS, whole), c=("string", value)) is expected


@pytest.mark.parametrize("value, expected", [
    (0, "0B"), (1, "1.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (5 * 1024**4, "5.00 TB")])
def test_size_text(spark, value, expected):
    assert one(spark, text.size_text("c"), c=("bigint", value)) == expected


@pytest.mark.parametrize("path, expected", [
    ("/a/SRX12/Gene/Summary.csv", "SRX12"), ("file:/a/accession=SRX9/x.csv", "SRX9"), ("/a/ERX1/Summary.csv", None)])
def test_path_part_starting(spark, path, expected):
    assert one(spark, text.path_part_starting("p", "SRX"), p=("string", path)) == expected


def test_split_tags(spark):
    assert one(spark, text.split_tags("c"), c=("string", "a, b,,c")) == ["a", "b", "unknown", "c"]
    assert one(spark, text.split_tags("c"), c=("string", None)) == ["unknown"]


def test_capture_without_match_is_null(spark):
    assert one(spark, text.capture("c", r"^(.+)_(L[0-9]+)$", 2), c=("string", "K562_mRNA")) is None
    assert one(spark, text.capture("c", r"^(.+)_(L[0-9]+)$", 2), c=("string", "K562_mRNA_L003")) == "L003"


@pytest.mark.parametrize("value, expected", [
    (None, 0), (float("nan"), 0), (float("inf"), 0), (float("-inf"), 0), (3.9, 3), (-3.9, -3), (2.0, 2)])
def test_to_count(spark, value, expected):
    assert one(spark, numeric.to_count("c"), c=("double", value)) == expected


def test_number_and_int32(spark):
    assert one(spark, numeric.to_number("c"), c=("string", "3.5%")) is None
    assert one(spark, numeric.to_number("c"), c=("string", "3.5")) == 3.5
    assert one(spark, numeric.within_int32("c"), c=("bigint", 2**31)) is None
    assert one(spark, numeric.within_int32("c"), c=("bigint", -(2**31))) == -(2**31)


@pytest.mark.parametrize("current, previous, mode, expected", [
    (0.0, 0.0, "inf", None), (4.0, 0.0, "inf", math.inf), (4.0, 0.0, "null", None), (2.0, 4.0, "inf", -50.0)])
def test_change_percent(spark, current, previous, mode, expected):
    out = one(spark, numeric.change_percent("a", "b", mode), a=("double", current), b=("double", previous))
    assert out == expected


def test_rescale_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r[0] for r in numeric.rescale(df, "v", 300.0, 8000.0, "s").select("s").collect()] == [300.0, 300.0]


def test_date_windows(spark):
    def hit(column, at):
        return one(spark, column, t=("timestamp_ntz", at))

    window = dates.in_days("t", "2024-01-01", "2024-01-02")
    assert hit(window, datetime(2024, 1, 2, 23, 59, 59, 999999)) and not hit(window, datetime(2024, 1, 3))
    assert hit(window, datetime(2024, 1, 1)) and not hit(window, datetime(2023, 12, 31, 23, 59, 59))
    assert hit(dates.in_last_days("t", 7, datetime(2024, 1, 8)), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        dates.in_days("t", "2024-01-02", "2024-01-01")


def test_rules(spark):
    assert one(spark, rules.keep_or_other("c", ["a"]), c=("string", None)) == "other"
    found = rules.category_from_array("c", rules.FINE_CELL_RULES, "rest")
    assert one(spark, found, c=("array<string>", ["leukocyte", "monocyte"])) == "monocyte"
    assert one(spark, found, c=("array<string>", ["neuron"])) == "rest"
    kind = rules.category_from_text("c", rules.TOOL_KIND_RULES, "other")
    assert [one(spark, kind, c=("string", v)) for v in ("find_workflow_agent", "efetch", "esearch", "x")] == [
        "workflow", "fetch", "entrez", "other"]


def test_snake_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["Reads Mapped: Gene", "UMIs-in"])
    assert text.snake_columns(df).columns == ["reads_mapped__gene", "umis_in"]


def test_clean_counts(spark):
    df = spark.createDataFrame([("s", "x", "7.9", "n/a"), ("t", "y", None, "0.5")], "sample string, feature string, reads string, share string")
    out = numeric.clean_counts(df, ["sample", "feature"], ["reads"]).orderBy("sample").collect()
    assert [tuple(r) for r in out] == [("s", "x", 7, None), ("t", "y", 0, 0.5)]


def test_percent_text(spark):
    assert one(spark, text.percent_text(F.lit(0.12345))) == "12.35%" or one(spark, text.percent_text(F.lit(0.12345))) == "12.34%"
