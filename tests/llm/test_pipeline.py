"""The pipeline on a small scale: every stage's decisions hold in what follows."""


import public_tokenizers
from helpers import SMALL

import corpus_pipeline
from askwell.llm import fertility, minhash, pieces
from askwell.llm.common import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL), "test-stage")
        at[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    first = at["quality"][0]
    assert ids(at["quality"][1]) == {r.doc_id for r in fertility.quality_report(first, path).where("kept").collect()}
    assert ids(at["near_duplicates"][1]) == {r.doc_id for r in minhash.near_duplicates(at["near_duplicates"][0]).where("kept").collect()}
    assert ids(at["secrets"][1]) == ids(at["secrets"][0])
    assert ids(at["mixture"][1]) <= ids(at["mixture"][0])
    texts = {r.doc_id: r.text for r in at["mixture"][1].collect()}
    model = pieces.read_model(path)
    rows = docs.collect()
    assert len(rows) == at["mixture"][1].count()
    assert all(model.decode(r.tokens) == texts[r.doc_id] for r in rows)


def test_run_and_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "tokens"]
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
