"""Analyses, files and resumable work."""

import os
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfold import session
from tallyfold.plans import catalogues, forecast, labels, runlog, trends
from tallyfold.sources import files, sinks
from tallyfold.streaming import incremental as I

RELEASES = [("2020-05-01", "a", 5), ("2022-01-01", "a", 2), ("2021-03-01", "b", 3), (None, "a", 99), ("2021-01-01", None, 99)]


@pytest.fixture
def releases(spark):
    return spark.createDataFrame(RELEASES, "day string, tech string, cells int").withColumn("day", F.to_date("day"))


def test_cumulative_trend(releases, rows):
    out = trends.cumulative_trend(releases, "day", "tech", "cells", total_label="Total")
    assert rows(out, "period", "tech", "cumulative") == [
        (2020, "Total", 5), (2020, "a", 5), (2020, "b", 0), (2021, "Total", 8), (2021, "a", 5), (2021, "b", 3),
        (2022, "Total", 10), (2022, "a", 7), (2022, "b", 3)]


def test_last_running_total_is_the_group_total(releases):
    out = trends.cumulative_trend(releases, "day", "tech", "cells")
    assert out.groupBy("tech").agg((F.max("cumulative") == F.sum("cells")).alias("same")).where("not same").count() == 0


def test_top_n_rankings(spark, rows):
    df = spark.createDataFrame([("2020-01-01", "early", 6), ("2022-01-01", "late", 10), ("2021-01-01", "Other", 50)],
                               "day string, k string, n int").withColumn("day", F.to_date("day"))
    def top(**kw):
        return {r.k for r in trends.cumulative_trend(df, "day", "k", "n", top_n=1, exclude=["Other"], **kw).collect()}
    assert top() == {"late"} and top(rank_on="cumulative") == {"early"}
    with pytest.raises(ValueError):
        trends.cumulative_trend(df, "day", "k", "n", rank_on="x")


def test_proportions_sum_to_one(releases):
    out = trends.proportion_trend(releases, "day", "tech", "cells").groupBy("period").agg(F.round(F.sum("share"), 9).alias("s"))
    assert {r.s for r in out.collect()} == {1.0}


def test_collapse_rare(spark, rows):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("b", 9), (None, 50)], "l string, n int")
    assert rows(trends.collapse_rare(df, "l", "n", 10)) == [("Other", 9), ("a", 5), ("a", 5)]


def test_compare_catalogues(spark, rows):
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 2)], "t string, n int")
    b = spark.createDataFrame([("z", 9)], "t string, n int")
    out = catalogues.compare_catalogues({"one": a, "two": b}, ["t"], "n", top_n=2, scale=2)
    assert rows(out, "t", "catalogue", "n", "scaled") == [("x", "one", 6, 3.0), ("x", "two", 0, 0.0), ("z", "one", 0, 0.0), ("z", "two", 9, 4.5)]


def test_completeness_rules(spark, rows):
    def listing(acc, feature, skip=(), rules=catalogues.REQUIRED_FILES):
        own = feature if (feature, "raw") in rules else "*"
        return [(acc, feature, p, f) for (k, p), names in rules.items() if k == own for f in names if (p, f) not in skip]

    data = listing("SRX1", "Gene") + listing("SRX2", "Velocyto") + listing("SRX3", "Gene", {("filtered", "matrix.mtx.gz")})
    data += listing("SRX4", "Velocyto", {("filtered", "UniqueAndMult-EM.mtx.gz")})
    manifest = spark.createDataFrame(data, "accession string, feature string, processing string, file string")
    required = catalogues.required_files(spark)
    assert rows(catalogues.complete_datasets(manifest, required)) == [("SRX1", "Gene"), ("SRX2", "Velocyto")]
    assert rows(catalogues.missing_files(manifest, required), "accession", "processing", "file") == [
        ("SRX3", "filtered", "matrix.mtx.gz"), ("SRX4", "filtered", "UniqueAndMult-EM.mtx.gz")]
    private = catalogues.required_files(spark, catalogues.REQUIRED_FILES_PRIVATE)
    assert ("SRX4", "Velocyto") in rows(catalogues.complete_datasets(manifest, private))


def test_summary_files_to_result_table(spark, rows, tmp_path):
    for acc, feature, text in [("SRX1", "Gene", "Number of Reads,1200\nReads Mapped to Gene Unique,0.5\n"),
                               ("SRX1", "GeneFull_Ex50pAS", "Number of Reads,inf\nReads Mapped to GeneFull_Ex50pAS Unique,0.7\n"),
                               ("SRX2", "Gene", "Number of Reads,7\n"), ("ERX9", "Gene", "Number of Reads,7\n")]:
        folder = tmp_path / "star" / acc / "Solo.out" / feature
        os.makedirs(folder)
        (folder / "Summary.csv").write_text(text)
        (folder / "other.csv").write_text("x,y\n")
    pairs = files.read_key_values(spark, str(tmp_path), "SRX")
    assert pairs.count() == 5
    out = catalogues.result_table(pairs, spark.createDataFrame([("SRX1",)], "accession string"), ["Number of Reads", "Reads Mapped to feature Unique"])
    assert rows(out, "sample", "feature", "number_of_reads", "reads_mapped_to_feature_unique") == [
        ("SRX1", "Gene", 1200, 0.5), ("SRX1", "GeneFull_Ex50pAS", 0, 0.7)]


def test_manifest_of_a_tree(spark, rows, tmp_path):
    for p in ("SRX1/Gene/raw/matrix.mtx.gz", "SRX1/Gene/filtered/matrix.mtx.gz", "SRX2/Velocyto/raw/spliced.mtx.gz", "tmp/x.gz"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("abc")
    out = files.manifest(spark, str(tmp_path), "*.gz", "SRX")
    assert rows(out, "accession", "feature", "processing", "file", "length") == [
        ("SRX1", "Gene", "filtered", "matrix.mtx.gz", 3), ("SRX1", "Gene", "raw", "matrix.mtx.gz", 3), ("SRX2", "Velocyto", "raw", "spliced.mtx.gz", 3)]
    assert files.manifest(spark, str(tmp_path)).count() == 4


def test_label_resolution(spark, rows):
    data = spark.createDataFrame([(1, "lung cancer"), (2, "Healthy control"), (3, "gout"), (4, None), (5, "abnormal gait")], "accession int, disease string")
    terms = spark.createDataFrame([("lung cancer", "M:1; M:2"), ("gout", "M:9")], "disease string, ids string")
    clusters = spark.createDataFrame([("M:1", 0), ("M:2", 8)], "node_id string, cluster_id int")
    names = labels.cluster_names(spark)
    out = labels.resolve_labels(data, terms, clusters, names)
    assert rows(out, "accession", "node_id", "multi_id", "cluster_id", "cluster_name") == [
        (1, "M:1", True, 0, "Cancer and Neoplasms"), (1, "M:2", True, 8, "Cardiovascular Diseases"),
        (2, None, None, 10, "Healthy"), (5, None, None, 10, "Healthy")]
    words = labels.resolve_labels(data, terms, clusters, names, whole_word=True)
    assert {r.accession for r in words.collect()} == {1, 2}
    assert rows(labels.term_abundance(terms, "ids")) == [("M:1", 1), ("M:2", 1), ("M:9", 1)]


def test_sample_sheet(spark, rows):
    runs = spark.createDataFrame([("K_mRNA_L001", "SRX2", "r1"), ("K_mRNA_L002", "SRX1", "r2"), ("K_mRNA", "SRX0", "r3"), ("D_L001", "SRX5", "r4")],
                                 "name string, experiment string, run string")
    sheet = labels.sample_sheet(runs)
    assert rows(sheet, "sample", "accession", "name", "lane") == [("SRX1", "r1", "K_mRNA", "L001"), ("SRX1", "r2", "K_mRNA", "L002")]
    assert labels.missing_samples(sheet, spark.createDataFrame([("SRX1",)], "sample string")).count() == 0


def test_taxonomy(spark, rows):
    old = spark.createDataFrame([("Leaf", "Leaf"), ("stem", "Other"), ("stem", "Other")], "tissue string, category string")
    new = spark.createDataFrame([("Leaf", '"Root";stem'), ("new", "x")], "tissue string, category string")
    assert rows(labels.refresh_taxonomy(old, new)) == [("Leaf", "root"), ("stem", "other")]


def test_tag_counts(spark, rows):
    df = spark.createDataFrame([("U:1, U:2",), ("U:1",), ("",), (None,)], "tags string")
    known = spark.createDataFrame([("U:1", "lung")], "tag string, label string")
    assert rows(labels.tag_counts(df, "tags", known, top_n=2)) == [("U:1", 2, "lung"), ("unknown", 2, "unknown")]


RUN_SCHEMA = ("id string, trace_id string, name string, run_type string, start_time timestamp, end_time timestamp, error string, "
              "inputs map<string,string>, outputs map<string,string>, invocation_params map<string,string>, metadata map<string,string>, tags array<string>, "
              "total_tokens bigint, prompt_tokens bigint, completion_tokens bigint, prompt_cost double, completion_cost double, total_cost double")


def run(i, trace, name, start, seconds, error=None, model="m1", tokens=10):
    t0 = datetime(2024, 1, 1, 0, 0, start)
    t1 = None if seconds is None else datetime.fromtimestamp(t0.timestamp() + seconds)
    return (str(i), trace, name, "tool", t0, t1, error, {"q": "x" * 300}, None, {"model": model}, None, ["t"], tokens, 1, 1, 0.1, 0.1, 0.5)


@pytest.fixture
def runs(spark):
    data = [run(1, "t1", "search", 1, 2.0), run(2, "t1", "fetch", 5, None), run(3, "t1", "search", 3, 4.0, "boom"), run(4, "t2", "fetch", 2, 0.0)]
    return spark.createDataFrame(data, RUN_SCHEMA)


def test_flat_runs(runs):
    flat = runlog.flatten_runs(runs).orderBy("run_id").collect()
    assert flat[0].duration_seconds == 2.0 and flat[1].duration_seconds is None and flat[2].status == "error"
    assert flat[0].input_keys == ["q"] and len(flat[0].input_summary) == 203 and flat[0].output_keys is None
    model = runlog.flatten_runs(runs, "model").first()
    assert model.model_name == "m1" and model.temperature is None
    with pytest.raises(ValueError):
        runlog.flatten_runs(runs, "chain")


def test_run_filter(runs):
    flat = runlog.flatten_runs(runs)
    assert runlog.filter_runs(flat).count() == 3
    assert runlog.filter_runs(flat, include_errors=True, min_duration=1).count() == 2
    assert runlog.filter_runs(flat, max_duration=10).count() == 1
    assert runlog.filter_runs(flat, names=["fetch"]).count() == 2
    with pytest.raises(ValueError):
        runlog.filter_runs(flat, min_duration=5, max_duration=1)


def test_workflows(runs, rows):
    flat = runlog.flatten_runs(runs)
    out = {r.trace_id: r for r in runlog.workflow_summary(flat).collect()}
    t = out["t1"]
    assert (t.run_count, t.total_duration, t.avg_duration, t.error_count, t.unique_names) == (3, 6.0, 2.0, 1, 2)
    assert (t.first_name, t.last_name, t.workflow_end) == ("search", "fetch", None)
    assert rows(runlog.name_sequence(flat).drop("length")) == [("t1", 1, "search"), ("t1", 2, "search"), ("t1", 3, "fetch"), ("t2", 1, "fetch")]
    assert tuple(runlog.workflow_overview(runlog.workflow_summary(flat)).first()) == (2, 4, 2.0)


def test_run_stats(runs):
    flat = runlog.flatten_runs(runs)
    stats = [(r.name, r.call_count, r.error_rate, r.median_duration) for r in runlog.run_stats(flat).collect()]
    assert stats == [("fetch", 2, 0.0, 0.0), ("search", 2, 0.5, 3.0)]
    assert runlog.overall_stats(flat).first().median_duration == 2.0


def test_yield_estimate(spark):
    df = spark.createDataFrame([("o", 100, True), ("o", 0, True), ("o", 0, False), ("o", 0, False), ("p", 0, False)], "org string, n int, done boolean")
    out = forecast.extrapolate_yield(df, "n", "done", ["org"]).collect()
    assert len(out) == 1 and out[0].estimated_cells == 100 * 2 * 0.75 + 100 and out[0].delta == 150


def test_report_and_delimited_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', [1, 2])], "id int, note string, parts array<int>")
    places = sinks.write_report({"a": df}, str(tmp_path / "r"))
    back = files.read_delimited(spark, places["a"], "id int, note string, parts string")
    assert rows(back) == [(1, 'say "hi", you', "[1,2]")]
    sinks.write_report({"a": df}, str(tmp_path / "j"), kind="json")
    assert spark.read.json(str(tmp_path / "j" / "a")).count() == 1


def test_nested_counts_file(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text('{"lung": {"T cell": 3,\n "B cell": 1}, "skin": {}}')
    out = files.read_nested_counts(spark, str(tmp_path / "c.json"), multi_line=True)
    assert rows(out.select("outer", F.explode("counts"))) == [("lung", "B cell", 1), ("lung", "T cell", 3)]


def test_id_list(spark, rows, tmp_path):
    (tmp_path / "ids").write_text("A1\n\n# no\n  B2 \n")
    assert rows(files.read_id_list(spark, str(tmp_path / "ids"))) == [("A1",), ("B2",)]
    assert files.read_id_list(spark, str(tmp_path / "ids"), comments=False).count() == 3


def test_pending_and_carry_on(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "k string")
    done = spark.createDataFrame([("a", "ok"), ("b", "failed")], "k string, status string")
    assert rows(I.pending(df, done, "k")) == [("b",), ("c",), ("d",)]
    assert rows(I.pending(df, done, "k", retry_failed=False)) == [("c",), ("d",)]


def test_carry_on_works_once_and_keeps_finished_chunks(spark, rows, tmp_path):
    df = spark.createDataFrame([(k,) for k in "aabcdefgh"], "k string")
    done = spark.createDataFrame([("a", "ok"), ("b", "failed")], "k string, status string")
    path, calls = str(tmp_path / "results"), []
    done.write.parquet(path)

    def work(todo):
        keys = [r.k for r in todo.collect()]
        calls.extend(keys)
        if len(calls) > 4:
            raise RuntimeError("cut off")
        return todo.withColumn("status", F.lit("ok"))

    with pytest.raises(RuntimeError):
        I.carry_on(df, path, done.schema, "k", work, chunk_rows=2)
    finished = I.newest_results(I.results_at(spark, path, done.schema), "k").where("status = 'ok'").count() - 1
    assert 0 < finished < len(calls)
    again = []
    out = I.carry_on(df, path, done.schema, "k", lambda todo: again.extend(r.k for r in todo.collect()) or todo.withColumn("status", F.lit("ok")))
    assert rows(out) == [(k, "ok") for k in "abcdefgh"] and len(again) == len(set(again)) == 7 - finished
    assert rows(I.carry_on(df, str(tmp_path / "new"), done.schema, "k", lambda t: t.withColumn("status", F.lit("ok")))) == [(k, "ok") for k in "abcdefgh"]


def test_isolated_failures(spark, rows):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"], "n": [int(v) for v in pdf["k"]]})

    schema = StructType([StructField("k", StringType()), StructField("n", LongType())])
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "k string")
    out = rows(I.isolated(df, work, schema))
    assert [(r[0], r[1], r[2]) for r in out] == [("1", 1, "ok"), ("3", 3, "ok"), ("x", None, "failed")]
    assert out[2][3].startswith("ValueError")


def test_isolated_failures_of_one_file_are_spread_and_go_on_in_few_frames(spark, tmp_path):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["k"] % 50 == 0).any():
            raise ValueError("fifty")
        return pd.DataFrame({"k": pdf["k"], "n": pdf["k"] + 2 ** 60, "task": TaskContext.get().partitionId()})

    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    schema = StructType([StructField("k", LongType()), StructField("n", LongType()), StructField("task", LongType())])
    out = I.isolated(spark.read.parquet(f"{tmp_path}/one").withColumnRenamed("id", "k"), work, schema).collect()
    assert sorted((r.k, r.status) for r in out) == [(k, "ok" if k % 50 else "failed") for k in range(20_000)]
    assert len({r.task for r in out if r.status == "ok"}) >= 8
    assert all(r.n == 2 ** 60 + r.k for r in out if r.k % 50) and all(r.error == "ValueError: fifty" for r in out if r.k % 50 == 0)


def test_isolated_rows_that_vanish_or_hang(spark, rows):
    def short(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[pdf["k"] != "2"]

    schema = StructType([StructField("k", StringType())])
    df = spark.createDataFrame([(str(i),) for i in range(6)], "k string")
    assert [r[:2] for r in rows(I.isolated(df, short, schema))] == [(str(i), "failed" if i == 2 else "ok") for i in range(6)]

    def slow(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["k"] == "3").any():
            time.sleep(60)
        return pdf

    out = rows(I.isolated(df, slow, schema, timeout=0.5))
    assert [r[:2] for r in out] == [(str(i), "failed" if i == 3 else "ok") for i in range(6)]
    assert out[3][2].startswith("TimeoutError")


def test_followed_files(spark, rows, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    inbox, table = str(tmp_path / "in"), I.VersionedTable(spark, str(tmp_path / "table"), schema, ["k"])

    def arrive(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)

    def follow():
        return I.follow_files(spark, inbox, schema, table, ["v"])

    arrive([(1, "a"), (2, "b"), (2, "c")])
    assert rows(follow()) == [(1, "a"), (2, "b")]
    arrive([(2, None), (3, "d")])
    assert rows(follow()) == [(1, "a"), (2, None), (3, "d")]
    assert rows(follow()) == [(1, "a"), (2, None), (3, "d")]
    arrive([(1, "z")])
    assert rows(follow()) == [(1, "z"), (2, None), (3, "d")]
    table.merge(spark.createDataFrame([(1, "z")], schema), 2, ["v"])  # a batch that runs twice
    assert rows(table.read()) == [(1, "z"), (2, None), (3, "d")]
    (tmp_path / "table" / "checkpoint").rename(tmp_path / "lost")
    with pytest.raises(ValueError):
        follow()


def test_per_dataset_output_skips_done(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "dataset string, v int")
    path = str(tmp_path / "out")
    sinks.write_per_dataset(df.where("dataset = 'a'"), path, "dataset")
    sinks.write_per_dataset(df, path, "dataset", spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


def test_per_dataset_output_keeps_null_keys(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "dataset string, v int")
    path = str(tmp_path / "out")
    sinks.write_per_dataset(df, path, "dataset", rows_per_file=1)
    assert rows(spark.read.parquet(path), "dataset", "v") == rows(df)
    sinks.write_per_dataset(df, path, "dataset", spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


class FakeSession:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{id(self)}"})()
        self.conf = conf


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x").startswith(configured or session.shared_folder(spark))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    assert session.shared_folder(FakeSession("spark://host", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_folder_without_a_setting():
    local = FakeSession("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local)
    with pytest.raises(ValueError):
        session.shared_folder(FakeSession("spark://host"))


def test_folded_batches_are_not_read_again(spark, rows, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    table = I.VersionedTable(spark, str(tmp_path / "t"), schema, ["k"])
    inbox, want = str(tmp_path / "inbox"), {}

    def follow(after):
        return I.follow_files(spark, inbox, schema, table, ["v"], fold_after=after)

    for turn in range(5):
        new = {turn: f"a{turn}", 100: f"b{turn}"}
        want |= new
        spark.createDataFrame(list(new.items()), schema).coalesce(1).write.mode("append").parquet(inbox)
        assert rows(follow(2)) == sorted(want.items())
    assert table._base() == 3 and not table.fold(2)
    # what the base covers can change without being seen; a later batch counts
    broken = spark.createDataFrame([(0, "broken", 0), (7, "broken", 1)], "k long, v string, _version long")
    broken.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version").parquet(table.rows)
    assert rows(table.read()) == sorted(want.items()) and rows(follow(2)) == sorted(want.items())
    # a base that was written but not noted does not count, and is written again
    spark.createDataFrame([(9, "half")], schema).write.parquet(f"{table.bases}/4")
    assert rows(table.read()) == sorted(want.items())
    assert table.fold(1) and rows(table.read()) == sorted(want.items()) and table._base() == 4


def test_nothing_to_fold(spark, tmp_path):
    table = I.VersionedTable(spark, str(tmp_path / "t"), StructType([StructField("k", LongType())]), ["k"])
    assert not table.fold(0) and table.read().count() == 0
