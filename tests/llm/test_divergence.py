"""Source divergence against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import SMALL, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from askwell.llm import divergence
from askwell.llm.common import text_bytes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_hand(rows, min_docs, top=50):
    """rows: (text, lang, source)."""
    rows = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        df = Counter(t for words, _, _ in own for t in set(words))
        kept = sorted(t for t in df if df[t] >= min_docs)
        share = lambda counts: {
            t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept
        }
        q = share(Counter(t for words, _, _ in own for t in words))
        counts = {s: Counter(t for words, _, x in own if x == s for t in words) for s in {r[2] for r in own}}
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in p if b != s]
            more = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_documents_as_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    want = by_hand(rows, 3)
    assert {r[2] for r in want} == {"pair", "term"}
    assert sorted(rows_of(divergence.source_divergence(docs, 3))) == want


def test_blocks_and_parts_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(rows_of(divergence.source_divergence(docs, 3)))
    monkeypatch.setattr(divergence, "CELLS", (200, 500))
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "RUNS", 500)
    assert sorted(rows_of(divergence.source_divergence(docs, 3))) == want


def test_odd_rows(spark):
    long = "Ünïcödé" * 3000  # one term of 33,000 bytes
    rows = [
        ("alpha Beta beta", "xx", "a"), ("alpha beta", "xx", "b"), ("alpha beta", "xx", "b"),  # repeated rows count each
        (None, "xx", "c"), ("", None, None), ("alpha", None, "a"), (f"{long} x1y2 {long}", "xx", None), (long, "xx", "a"),
        ("seventeen-letters abcdefghijklmnopq abcdefghijklmnop abcdefgh abcdefghi", "xx", "d"),
        ("ABCDEFGHIJKLMNOPQ ABCDEFGHIJKLMNOP ABCDEFGH ABCDEFGHI", "xx", "e"), ("one source only", "yy", "z"), ("123 456", "zz", "n"), ("!", "zz", "m"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int")
    got = sorted(rows_of(divergence.source_divergence(docs.repartition(3), 2)))
    assert got == by_hand(rows, 2)
    assert ("zz", "m", "pair", "n", 0, 1) in got and not [r for r in got if r[0] == "yy" and r[2] == "pair"]
    assert rows_of(divergence.source_divergence(docs.limit(0))) == []


def test_shares_beyond_64_bits(spark):
    n = 50_000_000_000
    got = spark.range(1).select(divergence._share(divergence.F.lit(n), divergence.F.lit(3 * n), divergence.F.lit(7))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abAB é1 京\n", max_size=60), st.integers(0, 2)), max_size=12), st.integers(1, 4))
def test_runs_count_terms(texts, cuts):
    runs = divergence.TermRuns()
    for part in np.array_split(np.arange(len(texts)), cuts):
        data, at = text_bytes(pa.array([texts[i][0] for i in part], pa.string()))
        runs.add(np.frombuffer(data.tobytes().lower(), np.uint8), at, np.array([texts[i][1] for i in part], np.int64))
    got = {}
    for batch in runs.batches([("l", str(g)) for g in range(3)]):
        for row in batch.to_pylist():
            assert (row["source"], row["term"]) not in got
            got[row["source"], row["term"]] = row["n"], row["docs"]
    want = {}
    for text, g in texts:
        for t, n in Counter(terms(text)).items():
            a, b = want.get((str(g), t), (0, 0))
            want[str(g), t] = a + n, b + 1
    assert got == want
