"""The pipeline stage by stage, each on what the one before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import decontaminate, quality

from test_near_dedup import plain_groups


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "packing"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 3:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        ids, left = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, docs))
        assert left <= ids and docs.count() > 0
        kept.append((before, docs, ids, left))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    _, _, ids, left = kept[0]
    assert sum(labels[k] == 1 for k in ids - left if k in labels) <= 2 and sum(labels[k] == 0 for k in left if k in labels) <= 2
    before, after, ids, left = kept[1]
    groups, _ = plain_groups({r.doc_id: r.text for r in before.collect()})
    assert left == set(groups.values()) and after.count() == len(left) < before.count()
    before, after, ids, left = kept[2]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contaminated(after, bench).count() == 0
    assert ids - left == {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
    assert kept[3][3] == kept[3][2]


def test_rows_of_all_kinds(spark, sf):
    rows = [(1, "a good text of words", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (1, "a good text of words", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(0.1))
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()) == ["1", "2"]
    assert corpus_pipeline.packed(spark, docs, sf).select(F.sum(F.col("length"))).first()[0] > 0


def test_no_contaminated_row_stays(spark, sf):
    """Rows that share an id, or have none, are judged by their own texts."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(8, "a clean text"), (8, "so " + item), (None, item), (None, "clean without an id"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_benchmark(spark, docs, sf).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(8, "a clean text"), (None, "clean without an id"), (9, None)]))


def test_run_is_its_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert quality.MAX_ROWS == 20_000
