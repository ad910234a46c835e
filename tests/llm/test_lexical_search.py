"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
from helpers import SMALL, rows_of

from askwell.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    N, L = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        hits = []
        for d, c, n in counted:
            m = 25 + (75 * n * N) // L
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return sorted(out, key=repr)


def got(docs, items, **how):
    return sorted(rows_of(lexical_search.ranked_search(docs, items, **how)), key=repr)


def test_benchmark_as_by_hand(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs.repartition(6), items) == want


def test_blocks_and_portions_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = got(docs, items)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 900)
    monkeypatch.setattr(lexical_search, "PORTION_DOCS", 16)
    assert got(docs, items) == want


def test_odd_rows(spark):
    texts = ["red green blue", "Red RED green", None, "", "!!", "red " * 30_000 + "rare", "blau grün", "red green blue", "x9 y9"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "red green blue"), (7, "red green blue"), (None, "red")]
    asked = [(1, "red red green"), (1, "red red green"), (2, None), (3, ""), (4, "GRÜN grün"), (5, "unknown words"), (None, "rare x9"), (6, "a-b " * 900 + "blue")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, terms int")
    items = spark.createDataFrame([(*r, 1) for r in asked], "item_id long, text string, place int")
    for k in (1, 3, 10):
        assert got(docs.repartition(4), items, k=k) == by_hand(rows, asked, k)
    assert got(docs.limit(0), items) == [] and got(docs, items.limit(0)) == []


def test_few_accumulators_and_the_same_best():
    """Late, common terms open no accumulators once they can't reach the k-th score; results stay exact."""
    rng = np.random.default_rng(3)
    docs, size, k = 4000, 12, 10
    cells = [(d, t) for t in range(size) for d in np.flatnonzero(rng.random(docs) < 0.9 * 2.0 ** (t - size + 1)).tolist()]
    owner, term = np.array(cells).T
    impact = rng.integers(1, 200_000, len(cells))
    # A rare term's hits are far ahead of all that the others can add.
    impact[term == 3] += 600_000
    weight = [4000 >> t for t in range(size)]
    portion = lexical_search.Portion(np.arange(docs), owner, term, impact, size)
    score, ids, opened = portion.best(list(zip(range(size), weight)), k, 0)
    full = np.bincount(owner, impact * np.array(weight)[term], docs).astype(np.int64)
    want = np.lexsort((np.arange(docs), -full))[:k]
    assert ids.tolist() == want.tolist() and score.tolist() == full[want].tolist()
    assert opened < 0.2 * np.count_nonzero(full)
    # A k-th score known from elsewhere leaves out what doesn't reach it, ties stay.
    limit = int(full[want[4]])
    assert portion.best(list(zip(range(size), weight)), k, limit)[1].tolist() == [d for d in want.tolist() if full[d] >= limit]


def test_impacts_beyond_64_bits():
    n, docs, words = np.array([10**9, 5]), 10**12, 10**15
    want = [10**9 * 3 // (3000 + 8 * (25 + 75 * int(x) * docs // words)) for x in n]
    assert lexical_search.impacts(np.array([3, 3]), n, docs, words).tolist() == want
