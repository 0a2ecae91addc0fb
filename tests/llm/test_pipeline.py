from __future__ import annotations

import zlib

from edges import documents, labels

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_hand_over_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "substring_dedup":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "quality_classifier":
            # A calibrated classifier may err: a bound for rows it has learnt from and one for the 19 held-out ones (18 right when
            # it was set; 0.996 of the larger tables' held-out rows are).
            for held_out, least in ((False, 0.97), (True, 0.9)):
                judged = [i for i in before if i in known and (zlib.crc32(str(i).encode()) % 5 == 0) == held_out]
                right = sum((known[i]["quality"] == 1) == (i in after) for i in judged)
                assert len(judged) > 10 and right >= least * len(judged)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_run_is_the_stages_in_turn(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
