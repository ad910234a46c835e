"""The mix of sources against a plain walk."""

import hashlib
import math

from helpers import SMALL, rows_of

from askwell.llm import mixing


def by_hand(sizes):
    """Targets by repeated resharing. sizes: (source, size) in source order."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total = 1.5 * sum(s for _, s in sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while open_:
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * sizes[i][1]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 2.0 * sizes[i][1]
            rest -= target[i]
        open_ -= over
    return {s: t for (s, _), t in zip(sizes, target)}


def test_targets_and_words_taken(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    rows = rows_of(mixing.mixed_copies(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    assert len(rows) == docs.count()
    sizes = {}
    for _, source, size, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size
    want = by_hand(sorted(sizes.items()))
    for source in sizes:
        own = [r for r in rows if r[1] == source]
        assert all(abs(r[4] - want[source]) < 1e-6 and r[3] == sizes[source] and r[5] in (0, 1, 2) and r[6] == r[5] * r[2] for r in own)
        assert abs(sum(r[6] for r in own) - want[source]) <= max(r[2] for r in own)
        n = want[source] / sizes[source] * len(own)
        assert math.floor(n) <= sum(r[5] for r in own) <= math.ceil(n)
    again = rows_of(mixing.mixed_copies(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    assert sorted(again) == sorted(rows)


def test_odd_rows_and_the_documents_themselves(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 5000, None), (None, "q", "t"), (5, "a b c", "s"), (5, "a b c", "s")]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, size int, k0 string")
    got = rows_of(mixing.mixed_copies(docs).select("doc_id", "source", "copies", "taken"))
    assert len(got) == len(rows)
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r[2] for r in got)
    assert taken.dtypes == docs.dtypes and {(r["size"], r["k0"]) for r in taken.collect()} == {(7, "k")}
    assert rows_of(mixing.mixed_copies(docs.limit(0))) == [] and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_the_offset_is_a_hash_of_the_source(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    shift = mixing.source_targets(docs.selectExpr("source", "1L size")).first()["shift"]
    assert shift == int(hashlib.md5(b"mix-1s").hexdigest()[:8], 16) / 2**32
