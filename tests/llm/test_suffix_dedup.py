"""Removed bytes against a plain search for repeated strings."""

import hashlib

import numpy as np
import pytest
from helpers import SMALL, rows_of

from askwell.llm import suffix_dedup
from askwell.llm.suffix_dedup import SPAN


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - SPAN + 1):
            window = raw[i : i + SPAN]
            if window in seen:
                gone[i : i + SPAN] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(frame, **how):
    return {r[0]: r[1:5] for r in rows_of(suffix_dedup.repeated_spans(frame, **how))}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("hot", [3, 10**6])
def test_near_copies_periods_and_common_lines(spark, hot):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    base, line = word(900), word(120)
    rows = []
    for i in range(60):
        kind = i % 6
        text = list(base)
        if kind == 0:
            text = list(word(500))
        for at in rng.integers(0, len(text), 4):
            text[at] = "Z"
        text = "".join(text)
        if kind == 2:
            text = line + "\n" + word(200) + line + word(30) + line
        if kind == 3:
            text = "a" * int(rng.integers(90, 400)) + word(50) + "ab" * 150
        if kind == 4:
            text = base[100:] + base[:300]
        rows.append((i * 7, text))
    rows += [(1000 + i, base) for i in range(20)] + [(2000, None), (2001, ""), (2002, "x" * 99), (2003, "x" * 100), (2004, "x" * 100), (2005, "y" * 101)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(frame, hot=hot) == brute(rows)


def test_odd_rows(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 300))
    rows = [(1, long, "x"), (1, long, "y"), (None, long, "z"), (2, "q" + long, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, uid string").withColumnRenamed("uid", "copy")
    got = result(frame)
    assert got == {1: brute([(1, long)])[1], 2: brute([(1, long), (2, "q" + long)])[2], None: (300, 300, 1, hashlib.sha256(b"").hexdigest())}
    spans = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.repeated_spans(frame).collect()}
    assert spans[2] == [(1, 301)] and spans[1] == []
    assert result(frame.limit(0)) == {}


def test_every_row_without_an_id_has_a_result(spark):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh"), 260))
    texts = [base[:150], base[:200], base[100:], "short", "short", base, base, base, None, None, ""]
    frame = spark.createDataFrame([(None, t) for t in texts] + [(5, base[50:180])], "doc_id long, text string")
    got = [tuple(r)[:5] for r in suffix_dedup.repeated_spans(frame).collect()]
    assert sorted(r[1] for r in got) == sorted([len(t or "") for t in texts] + [130])
    # In the order in which the documents are taken, the named one first.
    keys = {t or "": h for t, h in spark.createDataFrame([(t or "",) for t in set(texts)], "t string").selectExpr("t", "pmod(xxhash64(t), 4611686018427387903)").collect()}
    order = [base[50:180], *sorted((t or "" for t in texts), key=keys.get)]
    want = brute(list(enumerate(order)))
    assert sorted(r[1:] for r in got) == sorted(want.values())
    assert [r for r in got if r[0] == 5][0][1:] == want[0]
