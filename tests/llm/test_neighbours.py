"""Nearest neighbours against brute force: exact scores and order, and recall."""

import math

import numpy as np
from helpers import SMALL, rows_of

from askwell.llm import neighbours


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in fine:
        if q % 100 == 0:
            near = sorted((math.sqrt(((a - b) ** 2).sum()), i) for i, b in fine if i != q and len(a) == len(b))
            out[q] = near[:k]
    return out


def check(spark, frame, least):
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = brute(rows, 10)
    got = {}
    for q, rank, i, score in sorted(rows_of(neighbours.nearest_neighbours(frame, lambda c: c % 100 == 0))):
        assert rank == len(got.setdefault(q, [])) + 1
        got[q].append((score, i))
    assert set(got) <= set(want)
    hits = 0
    for q, near in want.items():
        have = got.get(q, [])
        assert have == sorted(have) and len({i for _, i in have}) == len(have)
        exact = {i: s for s, i in near}
        for s, i in have:
            if i in exact:
                assert abs(s - exact[i]) < 1e-9
                hits += 1
    total = sum(map(len, want.values()))
    assert hits >= least * total, (hits, total)


def test_recall_on_the_table(spark):
    check(spark, spark.read.parquet(f"{SMALL}/embeddings.parquet"), 0.9)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(250)]  # copies beyond k, with queries among them
    rows += [(300 + i, rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(1000, None), (1100, []), (1200, [0.0, 0.0, 0.0]), (1300, [1.0, None, 2.0]), (1400, [float("nan"), 1.0, 1.0]), (1500, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1600, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rep string, bucket int")
    check(spark, frame, 0.9)
    assert rows_of(neighbours.nearest_neighbours(frame.limit(0), lambda c: c % 100 == 0)) == []


def test_buckets_come_in_falling_probability():
    got = neighbours.visited(np.array([0.1, 2.5, -1.7]), 0.5, 0.99)
    assert got[0].tolist() == [0, 2, -2]
    assert len({tuple(b) for b in got.tolist()}) == len(got)

    def p(b):
        out = 1.0
        for x, lo in zip((0.1, 2.5, -1.7), b):
            out *= neighbours._below((lo + 1 - x) / 0.5) - neighbours._below((lo - x) / 0.5)
        return out

    ps = [p(b) for b in got]
    assert all(a >= b - 1e-12 for a, b in zip(ps, ps[1:])) and sum(ps) >= 0.99


def test_clusters_of_near_copies_do_not_narrow_the_search(spark):
    rng = np.random.default_rng(9)
    rows = [rng.normal(size=16) for _ in range(600)]
    rows += [rows[i % 20] + rng.normal(size=16) * 1e-4 for i in range(600)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    check(spark, frame, 0.9)


def test_queries_beyond_the_most_buckets_meet_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 3)
    monkeypatch.setattr(neighbours, "SPLIT", 100)
    check(spark, spark.read.parquet(f"{SMALL}/embeddings.parquet"), 1.0)
    assert neighbours.visited(np.array([0.5, 0.5]), 0.5, 0.9999) is None
