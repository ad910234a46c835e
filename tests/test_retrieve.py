import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askwell.operators import retrieve
from askwell.operators.embed import bag_of_words, batch_model, check_same_embedder, hashed_words, term_counts
from askwell.operators.retrieve import nearest, slice_hits
from askwell.plans.answer import answer_hits, answer_prompts

WORDS = "red blue green sky sea the of and old new".split()


def texts(seed, count):
    rng = np.random.default_rng(seed)
    return [(f"c{i:03d}", " ".join(rng.choice(WORDS, rng.integers(1, 9)))) for i in range(count)]


def brute(chunks, questions, k):
    def cosine(a, b):
        dot = sum(a[t] * b[t] for t in a)
        return dot and dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    out = set()
    for q, question in questions:
        scored = []
        for c, text in chunks:
            similarity = cosine(Counter(question.split()), Counter(text.split()))
            if similarity:
                scored.append((round(1 - similarity, 9), c))
        out |= {(q, c, n + 1) for n, (_, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("per_slice, cells", [(10_000, 4_000_000), (3, 50)])
def test_terms_like_brute_force(spark, monkeypatch, per_slice, cells):
    monkeypatch.setattr(retrieve, "SLICE_QUESTIONS", per_slice)
    monkeypatch.setattr(retrieve, "CELLS", cells)
    chunks, questions = texts(1, 150) + [("empty", " ")], texts(2, 12) + [("none", "zebra")]
    stored = spark.createDataFrame(chunks, "chunk_id string, content string").repartition(5)
    asked = spark.createDataFrame(questions, "query_id string, text string")
    for k in (1, 5, 400):
        hits = answer_hits(stored, asked, k=k).collect()
        assert {(h.query_id, h.chunk_id, h["rank"]) for h in hits} == brute(chunks, questions, k)


def test_dense_like_brute_force(spark):
    rng = np.random.default_rng(0)
    stored, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    stored[10] = stored[20] = asked[3]
    schema = "{} bigint, vector array<float>"
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)] + [(999, [0.0] * 8)], schema.format("chunk_id"))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], schema.format("query_id"))
    got = {(h.query_id, h["rank"]): h.chunk_id for h in nearest(s.repartition(4), q).collect()}
    a, b = stored.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    cosine = (b @ a.T) / np.outer(np.linalg.norm(b, axis=1), np.linalg.norm(a, axis=1))
    for i, row in enumerate(cosine):
        order = sorted(range(300), key=lambda j: (round(1 - row[j], 9), j))[:5]
        assert [got[i, r] for r in range(1, 6)] == order


def test_no_pairs_are_shuffled(spark):
    stored = spark.createDataFrame(texts(1, 20), "chunk_id string, content string")
    asked = spark.createDataFrame(texts(2, 3), "query_id string, text string")
    stored, asked = bag_of_words()(stored), bag_of_words()(asked, "text")
    found, shared = slice_hits(stored.selectExpr("chunk_id id", "vector"), asked.select("query_id", "vector"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shared.destroy()
    # k hits per question and task go to the lanes, k per question and lane to the last ranking.
    assert "Join" not in plan and "Cartesian" not in plan and plan.count("Exchange") == 2
    assert plan.count("WindowGroupLimit") >= 2


def test_embedders(spark):
    df = spark.createDataFrame([("a", "Red red, BLUE."), ("b", "")], "chunk_id string, content string")
    bags = {r.chunk_id: [tuple(t) for t in r.vector] for r in bag_of_words()(df).collect()}
    assert bags == {"a": [("blue", 1), ("red", 2)], "b": []}
    dense = {r.chunk_id: r.vector for r in hashed_words(16)(df).collect()}
    assert len(dense["a"]) == 16 and math.isclose(sum(x * x for x in dense["a"]), 1, rel_tol=1e-6)

    def load():
        return lambda batch: [[float(len(t)), 1.0] for t in batch]

    model = batch_model("length", load)
    assert {r.chunk_id: r.vector for r in model(df).collect()} == {"a": [14.0, 1.0], "b": [0.0, 1.0]}
    check_same_embedder(model(df), model)
    with pytest.raises(ValueError):
        check_same_embedder(model(df), bag_of_words())


def test_prompts(spark):
    stored = spark.createDataFrame([("a", "red sky"), ("b", "blue sea")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "re\nd sky "), (2, "zebra")], "query_id int, text string")
    prompts = {r.query_id: r.prompt for r in answer_prompts(stored, asked, system=F.lit("Be {kind}.")).collect()}
    pad = " " * 16
    assert prompts[1].startswith(
        f"Be {{kind}}.\n\n{pad}<context>\n{pad}red sky\n{pad}</context>\n\n{pad}User Question: red sky\n{pad}\n"
    )
    assert f"<context>\n{pad}\n{pad}</context>" in prompts[2]
    assert prompts[1].rstrip().endswith("saying context not given/provided.")
    default = answer_prompts(stored, asked, system=F.lit("")).first().prompt
    assert default.startswith("You are a helpful AI assistant.")


def test_dense_edge_cases(spark):
    schema = "{} int, vector array<float>"
    s = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 1.0, 0.0]), (4, []), (5, None)], schema.format("chunk_id"))
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], schema.format("query_id"))
    got = {(h.query_id, h.chunk_id): round(h.distance, 6) for h in nearest(s, q).collect()}
    assert got == {(1, 1): 0.0, (2, 2): 1.0}
    assert nearest(s, q.limit(0)).count() == 0 and nearest(s.limit(0), q).count() == 0


def test_an_unnamed_embedder_is_refused(spark):
    stored = spark.createDataFrame([("a", None)], "chunk_id string, embedder string")
    with pytest.raises(ValueError):
        check_same_embedder(stored, bag_of_words())


def test_counts_of_odd_texts(spark):
    odd = [(0, None), (1, ""), (2, " .\n,"), (3, "b a\tB\nc|c;é"), (4, "\x00 x"), (5, "zz")]
    got = spark.createDataFrame(odd, "i int, t string").select("i", term_counts("t").alias("v")).collect()
    want = {0: [], 1: [], 2: [], 3: [("a", 1), ("b", 2), ("c", 2), ("é", 1)], 4: [("\x00", 1), ("x", 1)], 5: [("zz", 1)]}
    assert {r.i: [tuple(c) for c in r.v] for r in got} == want


@pytest.mark.parametrize("wide, cells", [(0, 4_000_000), (10**9, 4_000_000), (10**9, 3), (5, 3)])
def test_scores_do_not_depend_on_how_cells_are_filled(spark, monkeypatch, wide, cells):
    monkeypatch.setattr(retrieve, "WIDE_TERM", wide)
    monkeypatch.setattr(retrieve, "CELLS", cells)
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    vectors = [[{"term": t, "tf": n} for t, n in v.items()] for v in ({"a": 1, "b": 2}, {}, {"b": 1, "z": 3}, {"a": 2, "c": 1})]
    asked = [[{"term": t, "tf": n} for t, n in v.items()] for v in ({"a": 2, "b": 1}, {"z": 1}, {"q": 1})]
    got = retrieve._TermScorer(pa.array(asked, kind)).distances(pa.array(vectors, kind))
    want = [[1 - 4 / 25**0.5, np.inf, 1 - 1 / 50**0.5, 1 - 4 / 25**0.5], [np.inf, np.inf, 1 - 3 / 10**0.5, np.inf], [np.inf] * 4]
    assert np.array_equal(np.round(got, 9), np.round(want, 9))
