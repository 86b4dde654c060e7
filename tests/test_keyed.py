"""Tables in buckets of their key: which files are read, written and left alone."""

import glob

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.keyed import KeyedTable
from tallyfold.session import scratch_path


@pytest.fixture
def kept(spark):
    base = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("n"), F.lit("x").alias("name"))
    made = KeyedTable(spark, scratch_path(spark, "keyed"), base.schema, ["id"], 16)
    made.create(base)
    return made


def _files(kept):
    return {b.rsplit("=", 1)[1]: sorted(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{kept.path}/_bucket=*")}


def _bucket_of(kept, ids):
    return {str(r[0]) for r in kept._placed(ids).select("_bucket").distinct().collect()}


def test_lookup_opens_the_buckets_of_its_ids(spark, kept):
    ids = spark.createDataFrame([(3,), (500,), (500,), (None,), (5000,)], "id int")  # another type than the table's
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = kept.rows_of(ids)
        assert sorted(r.id for r in found.collect()) == [3, 500]
        plan = found._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        read = [int(s.metrics().get("numFiles").get().value()) for s in scans if "PartitionFilters: [_bucket" in s.toString()]
        assert read == [len(_bucket_of(kept, ids.dropna()))] and read[0] <= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert kept.rows_of(ids.limit(0)).count() == 0


def test_untouched_buckets_keep_their_files(spark, kept):
    before = _files(kept)
    new = spark.createDataFrame([(3, None, "ignored"), (2000, 5, "b")], "id long, n int, other string")
    hit = _bucket_of(kept, new)
    assert kept.upsert(new, skip=()) == len(hit)
    after = _files(kept)
    assert {b for b in after if after[b] != before.get(b)} == hit
    rows = {r.id: (r.n, r.name) for r in kept.rows().collect()}
    assert len(rows) == kept.rows().count() == 1001
    assert rows[3] == (None, "x") and rows[2000] == (5, None) and rows[4] == (4, "x")


def test_running_again_changes_nothing(spark, kept):
    new = spark.createDataFrame([(3, 9), (2000, 5), (None, 1)], "id long, n int")
    assert kept.upsert(new, skip=()) > 0
    before, rows = _files(kept), sorted(kept.rows().collect(), key=str)
    assert kept.upsert(new, skip=()) == 0 and kept.update(new, skip=()) == 0
    assert _files(kept) == before and sorted(kept.rows().collect(), key=str) == rows and len(rows) == 1002


def test_update_inserts_nothing(spark, kept):
    new = spark.createDataFrame([(3, 9, 1), (3, 8, 0), (2000, 5, 0)], "id int, n long, at int")
    assert kept.update(new, ["at"], skip=()) == 1
    rows = {r.id: r.n for r in kept.rows().collect()}
    assert len(rows) == 1000 and rows[3] == 8


def test_empty_tables(spark, kept):
    assert kept.upsert(kept.rows().limit(0)) == 0
    none = KeyedTable(spark, scratch_path(spark, "keyed"), kept.schema, ["id"], 4)
    none.create(kept.rows().limit(0))
    assert none.rows().count() == 0
    assert none.upsert(kept.rows().limit(10), skip=()) > 0 and none.rows().count() == 10
    with pytest.raises(ValueError):
        KeyedTable(spark, kept.path, kept.schema.add("_bucket", "int"), ["id"], 4)
