"""The inverted index against scoring every chunk."""

import numpy as np
import pytest
from test_retrieve import brute, texts

from askwell.operators import postings
from askwell.operators.embed import bag_of_words, hashed_words
from askwell.operators.postings import PostingsIndex, ShardLists
from askwell.plans.answer import answer_hits, answer_prompts


def table(spark, rows):
    return bag_of_words()(spark.createDataFrame(rows, "chunk_id string, content string").repartition(3))


def hits(index, questions, k):
    asked = index.spark.createDataFrame(questions, "query_id string, text string")
    return {(h.query_id, h.chunk_id, h["rank"]) for h in answer_hits(index, asked, k=k).collect()}


@pytest.mark.parametrize("shard, slice_", [(2_000_000, 500_000), (40, 500_000), (40, 7)])
def test_like_brute_force(spark, tmp_path, monkeypatch, shard, slice_):
    monkeypatch.setattr(postings, "SLICE_TERMS", slice_)
    chunks, questions = texts(1, 150) + [("empty", " ")], texts(2, 12) + [("none", "zebra"), ("blank", " ")]
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=5, shard_postings=shard)
    index.add(table(spark, chunks))
    for k in (1, 5, 400):
        assert hits(index, questions, k) == brute(chunks, questions, k)


def test_additions_bring_only_new_chunks(spark, tmp_path):
    chunks, questions = texts(3, 90), texts(4, 6)
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=4)
    assert hits(index, questions, 3) == set() and index.additions() == []
    assert index.add(table(spark, chunks[:40]))
    assert index.add(table(spark, chunks[20:]))
    assert not index.add(table(spark, chunks)) and not index.add(table(spark, [("empty", "")]))
    assert index.additions() == [0, 1] and index.chunks().count() == 90
    assert hits(index, questions, 3) == brute(chunks, questions, 3)
    # An addition that was cut off doesn't count, and is made again.
    assert index.add(table(spark, [("new", "red zebra")]))
    (tmp_path / "index" / "chunks" / "added=2" / "_SUCCESS").unlink()
    assert hits(index, [("q", "zebra")], 3) == set()
    assert index.add(table(spark, [("new", "red zebra")])) and hits(index, [("q", "zebra")], 3) == {("q", "new", 1)}


def test_only_lists_of_the_asked_terms_are_read(spark, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=64)
    index.add(table(spark, [(f"c{i}", f"word{i} word{i + 1} common") for i in range(200)]))
    asked = bag_of_words()(spark.createDataFrame([(1, "word7"), (2, "word90")], "query_id int, text string"), "text")
    found = index.search(asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(h.query_id, h.chunk_id) for h in found.collect()} == {(1, "c6"), (1, "c7"), (2, "c89"), (2, "c90")}
    scan = next(line for line in str(plan).splitlines() if "FileScan" in line and "tfs" in line)
    assert "PartitionFilters: [isnotnull(part" in scan or "PartitionFilters: [part" in scan
    parts = {r.p for r in asked.selectExpr("explode(vector.term) t").select(index._part("t").alias("p")).collect()}
    some = index.lists().where(postings.F.col("part").isin(sorted(parts)))
    leaf = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert some.count() and some.collect() and leaf.metrics().apply("numFiles").value() == len(parts) == 2


def test_frequent_terms_are_cut_into_lists_of_bounded_size(spark, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=2, shard_postings=50)
    index.add(table(spark, [(f"c{i:03d}", f"the word{i}") for i in range(300)]))
    lists = index.lists().where("term = 'the'").collect()
    assert sum(len(r.docs) for r in lists) == 300 and max(len(r.docs) for r in lists) < 60 and len(lists) == 12
    assert all(r.docs == list(range(len(r.docs))) for r in lists)


def test_few_chunks_get_a_score_and_the_best_are_the_same():
    rng = np.random.default_rng(1)
    size, k = 5000, 5
    df = [30, 400, 3000, 4500]
    docs = [np.sort(rng.choice(size, n, replace=False)) for n in df]
    tfs = [rng.integers(1, 3, n) for n in df]
    tfs[0] += 6
    counts = np.zeros((len(df), size))
    for t, (d, tf) in enumerate(zip(docs, tfs)):
        counts[t, d] = tf
    squares = (counts**2).sum(0) + rng.integers(100, 120, size)
    most = np.array([(tf / np.sqrt(squares[d])).max() for d, tf in zip(docs, tfs)])
    lists = ShardLists(docs, tfs, [squares[d] for d in docs], most)
    asked = [(3, 1), (0, 3), (2, 1), (1, 1)]
    distance, found, scored = lists.best(asked, 12, k)
    weight = np.zeros(len(df))
    for t, tf in asked:
        weight[t] = tf
    full = np.round(1 - weight @ counts / np.sqrt(12 * squares), 9)
    want = np.lexsort((np.arange(size), full))[:k]
    assert found.tolist() == want.tolist() and distance.tolist() == full[want].tolist()
    assert scored < 1000 < np.count_nonzero(counts.sum(0))


def test_prompts_and_embedders(spark, tmp_path):
    chunks = table(spark, [("a", "red sky"), ("b", "blue sea")])
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=3)
    index.add(chunks)
    asked = spark.createDataFrame([(1, "red sea"), (2, "zebra")], "query_id int, text string")
    want = sorted(answer_prompts(chunks, asked).collect())
    assert sorted(answer_prompts(chunks.select("chunk_id", "content"), asked, index=index).collect()) == want
    with pytest.raises(ValueError):
        answer_hits(index, asked, hashed_words(16))


def test_vectors_of_an_addition_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @postings.F.udf("array<struct<term:string,tf:int>>")
    def vector(text):
        made.add(1)
        return [(word, 1) for word in text.split()]

    rows = spark.createDataFrame([(f"c{i}", f"w{i}" if i else "") for i in range(8)], "chunk_id string, content string")
    rows = rows.select("chunk_id", vector("content").alias("vector"), postings.F.lit("e").alias("embedder")).repartition(2)
    index = PostingsIndex(spark, str(tmp_path / "index"), parts=2)
    assert index.add(rows) and index.chunks().count() == 7 and made.value == 8
