"""Near duplicates against brute force over all pairs."""

import re

import numpy as np
import pyarrow as pa
from helpers import SMALL, rows_of

from askwell.llm import minhash
from askwell.llm.common import text_bytes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    lo, hi = sorted((root(i), root(j)))
                    parent[hi] = lo
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = rows_of(minhash.near_duplicates(docs, shingle=2))
    assert set(got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2)


def test_chains_and_hot_groups(spark):
    """Long chains of links, a large group around one text, and copies."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(40):  # each differs from the one before by few words
        base[rng.integers(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
        i += 1
    star = [f"s{j}" for j in range(80)]
    for _ in range(60):
        own = list(star)
        for j in rng.integers(0, 80, 4):
            own[j] = f"y{i}-{j}"
        rows.append((i, " ".join(own)))
        i += 1
    rows += [(i + j, " ".join(star)) for j in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert set(rows_of(minhash.near_duplicates(docs, shingle=2))) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "A  b\tc"), (None, "a b c"), (7, " \n "), (8, "q " * 40_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, bucket string")
    got = {(r[0], r[2], r[3]) for r in rows_of(minhash.near_duplicates(docs, shingle=5))}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (None, None, True), (7, 7, True), (8, 8, True)}
    kept = minhash.without_near_duplicates(docs.union(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8]
    assert rows_of(minhash.near_duplicates(docs.limit(0))) == []


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(400)]
    texts, truth = [], []
    for swap in (0, 10, 40, 120):
        other = list(words)
        for j in rng.choice(400, swap, replace=False):
            other[j] = f"n{j}"
        texts += [" ".join(words), " ".join(other)]
        a, b = shingles(texts[-2], 3), shingles(texts[-1], 3)
        truth.append(len(a & b) / len(a | b))
    values, at = minhash.shingle_sets(*text_bytes(pa.array(texts)), 3)
    packed, _ = minhash.signatures(values, at[:-1])
    assert np.abs(minhash.estimated(packed[::2], packed[1::2]) - truth).max() < 0.13


def test_small_sets_at_the_limit_are_not_lost():
    """Pairs at exactly 0.8, of few shingles: the estimate lets them through to the full sets."""
    rng = np.random.default_rng(7)
    for common, more in ((4, 1), (8, 2)):
        wide = rng.integers(0, 1 << 52, (40_000, common + more), dtype=np.uint64)
        signed = [minhash.signatures(x.ravel(), np.arange(len(x)) * x.shape[1]) for x in (wide[:, :common], wide)]
        (a, left), (b, right) = signed
        found = minhash.estimated(a, b)
        assert abs(found.mean() - 0.8) < 0.002 and found.std() < 0.032
        lost = (found < minhash.LEAST_ESTIMATE) | ~(left == right).any(1)
        assert lost.sum() <= 2


def test_prefix_index_finds_all_links():
    rng = np.random.default_rng(11)
    base = [rng.integers(0, 1 << 40, n) for n in (1, 3, 40, 300)]
    sets = []
    for _ in range(400):
        own = base[rng.integers(len(base))]
        keep = own[rng.random(len(own)) < rng.choice([0.7, 0.9, 0.97, 1.0])]
        more = rng.integers(0, 1 << 40, rng.integers(0, 1 + len(own) // 5))
        sets.append(np.unique(np.concatenate([keep, more])))
    sets = [s for s in sets if len(s)]
    plain = [set(s.tolist()) for s in sets]
    index = minhash.PrefixIndex(sets, 80)
    for i, own in enumerate(sets):
        want = [j for j, other in enumerate(plain) if 100 * len(plain[i] & other) >= 80 * len(plain[i] | other)]
        near = index.candidates(own)
        assert list(index.linked(own, near)) == want
    assert minhash.PrefixIndex([], 80).candidates(sets[0]).tolist() == []


def test_shared_boilerplate_makes_no_candidates():
    """Sets that share just too little, all of the same items, aren't compared at all."""
    common = np.arange(1000, 1196)
    sets = [np.concatenate([common, 10_000 + 40 * i + np.arange(40)]) for i in range(300)]
    index = minhash.PrefixIndex(sets, 80)
    assert all(index.candidates(own).tolist() == [i] for i, own in enumerate(sets))


def test_blocks_of_families_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAMILY", 700)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    test_chains_and_hot_groups(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert set(rows_of(minhash.near_duplicates(docs, shingle=2))) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2)


def test_long_sets_at_the_limit_are_not_lost():
    """Pairs at exactly 0.8, of many shingles: the estimate and the bands let them through."""
    rng = np.random.default_rng(17)
    lost = total = 0
    for common, more in ((80, 20), (800, 200), (4000, 1000)):
        n = 2_000_000 // (common + more) // 4
        wide = rng.integers(0, 1 << 52, (n, common + more), dtype=np.uint64)
        signed = [minhash.signatures(x.ravel(), np.arange(len(x)) * x.shape[1]) for x in (wide[:, :common].copy(), wide)]
        (a, left), (b, right) = signed
        found = minhash.estimated(a, b)
        assert abs(found.mean() - 0.8) < 0.01 and found.std() < 0.04
        lost += int(((found < minhash.LEAST_ESTIMATE) | ~(left == right).any(1)).sum())
        total += n
    assert total > 5000 and lost <= 1


def test_components_broadcast_nothing(spark, monkeypatch):
    """Rounds of small tables don't pass through the driver."""
    plans, plain = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda frame, name: plans.append(frame._jdf.queryExecution().toString()) or plain(frame, name))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 8)], "a long, b long")
    assert sorted(map(tuple, minhash.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_components_take_few_shuffles_and_files(spark, monkeypatch):
    """A round shuffles its edges twice and their ends once, and ends in fewer files than the shuffle has partitions."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(2000 + i, 2001 + i) for i in range(40)] + [(5000 + i, 4000) for i in range(300)]
    edges += [(b, a) for a, b in edges[:200]] + edges[:50]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(parent)):
        before = dict(parent)
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
        if parent == before:
            break
    seen, plain = [], minhash.written

    def written(frame, name):
        out = plain(frame, name)
        seen.append((frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning"), len(out.inputFiles())))
        return out

    monkeypatch.setattr(minhash, "written", written)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = rows_of(minhash.components(spark.createDataFrame(edges, "a long, b long")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(parent) and dict(got) == parent
    assert len(seen) > 2 and all(shuffles <= 3 and files <= 16 for shuffles, files in seen)
