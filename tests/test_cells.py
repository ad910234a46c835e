"""Dense retrieval by cells against scoring every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwell.operators import cells
from askwell.operators.cells import VectorCells
from askwell.operators.retrieve import nearest

SCHEMA = "{} bigint, vector array<float>"


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in rows], SCHEMA.format(name))


def clustered(rng, n, centres, spread):
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, centres.shape[1]))


@pytest.mark.parametrize("share, k", [(50_000, 5), (7, 3), (50_000, 900)])
def test_like_scoring_all(spark, tmp_path, monkeypatch, share, k):
    monkeypatch.setattr(cells, "SHARE_ROWS", share)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    rows = list(enumerate(clustered(rng, 600, centres, 0.3)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, 2.0]), (2005, [2.0, 1.0])]
    asked = list(enumerate(clustered(rng, 8, centres, 0.4))) + [(90, [1.0, 0.0]), (91, None), (92, [0.0] * 16), (93, [1.0, 2.0, 3.0])]
    stored, questions = frame(spark, rows, "chunk_id").repartition(4), frame(spark, asked, "query_id")
    index = VectorCells(spark, str(tmp_path / "cells"))
    index.build(stored)
    hits, looked = index.search(questions, k)
    usable = stored.where(F.forall("vector", lambda x: ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    columns = ["query_id", "chunk_id", "distance", "rank"]
    want = {tuple(r) for r in nearest(usable, questions, k).select(columns).collect()}
    assert {tuple(r) for r in hits.select(columns).collect()} == want
    if k == 5:  # well clustered: most vectors are never compared
        shares = {r.query_id: r.scored / r.stored for r in looked.collect()}
        assert sum(shares[i] for i in range(8)) / 8 < 0.4


def test_lengths_the_sample_lacks_and_no_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", 3)
    rows = [(i, [1.0, float(i)]) for i in range(40)] + [(100 + i, [1.0, 2.0, float(i)]) for i in range(3)]
    index = VectorCells(spark, str(tmp_path / "cells"))
    stored = frame(spark, rows, "chunk_id")
    index.build(stored)
    questions = frame(spark, [(1, [1.0, 3.2]), (2, [1.0, 2.0, 1.4])], "query_id")
    hits, _ = index.search(questions, 4)
    want = {tuple(r) for r in nearest(stored, questions, 4).select("query_id", "chunk_id", "rank").collect()}
    assert {tuple(r) for r in hits.select("query_id", "chunk_id", "rank").collect()} == want
    assert index.search(questions.limit(0))[0].count() == 0
    empty = VectorCells(spark, str(tmp_path / "none"))
    empty.build(stored.limit(0))
    assert empty.search(questions)[0].count() == 0
