from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm.common import stash

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_was_kept(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    per = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.where(F.col("n") > 4096).count() == 0


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_take_awkward_rows(spark, awkward):
    """Nulls, empty and long texts, repeated rows and clashing columns, through every stage."""
    docs, left = awkward, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == awkward.columns
        left.append(sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.select("doc_id").collect()))
    ids = [[i for known, i in rows if known] for rows in left]
    assert ids[0] == [1, 2, 2, *range(3, 14)] and len(left[0]) == 15  # nothing toxic
    assert ids[1] == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert ids[2] == [i for i in ids[1] if i not in (8, 9, 11)] and len(left[2]) == len(ids[2]) + 1
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    assert docs.where("offset < 0 or offset + length > 4096").count() == 0


def test_repeated_rows_are_kept_once_and_mixed_alike(spark, awkward):
    many = awkward.where("doc_id = 12").union(awkward.where("doc_id = 12")).union(awkward.where("doc_id is null")).union(awkward.where("doc_id is null"))
    kept = corpus_pipeline.drop_exact_copies(spark, many, SF)
    assert kept.count() == 2
    runs = [sorted(map(tuple, corpus_pipeline.mix_sources(spark, awkward.repartition(n), SF).select("doc_id", "text").na.fill(-1).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
