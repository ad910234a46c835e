"""Line dedup against a plain walk over all lines."""

import hashlib

from helpers import SMALL, rows_of

from askwell.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_chars=20, min_docs=3):
    """rows: (doc_id, text); the same rows as (doc_id, n_lines, n_dropped, kept)."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = {}
    for n, (_, lines) in enumerate(split):
        for line in lines:
            holders.setdefault(line.strip(BLANK).translate(LOWER), set()).add(n)
    out = []
    for doc_id, lines in split:
        kept = []
        for line in lines:
            key = line.strip(BLANK).translate(LOWER)
            ids = [split[n][0] for n in holders[key]]
            top = max((i for i in ids if i is not None), default=None)
            if not (len(key) >= min_chars and len(ids) >= min_docs and doc_id != top):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(docs, **how):
    return sorted(rows_of(line_dedup.without_shared_lines(docs, **how)), key=repr)


def test_documents_as_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_hand(rows)
    assert sum(r[2] for r in want) > 0
    assert got(docs) == sorted(want, key=repr)
    digests = {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in want}
    assert {r[0]: tuple(r[1:]) for r in rows_of(line_dedup.line_report(docs))} == digests


def test_odd_lines(spark):
    long = "A line that several documents share"
    rows = [
        (1, f"{long}\nown one\n  {long.lower()}\t"),  # twice, once in other letters and with blanks around
        (2, f"\x0b{long}\r\n\n"),
        (3, f"x\n{long}"),
        (3, f"x\n{long}"),  # a repeated row is a document of its own
        (None, f"{long}\nnull id"),
        (4, "nineteen characters"), (5, "nineteen characters"), (6, "nineteen characters"),
        (7, "äöüäöüäöüäöüäöüäöüäö"), (8, "äöüäöüäöüäöüäöüäöüäö"), (9, "äöüäöüäöüäöüäöüäöüäö"),  # 20 code points
        (10, "äöüäöüäöüäöüäöüäöüä"), (11, "äöüäöüäöüäöüäöüäöüä"), (12, "äöüäöüäöüäöüäöüäöüä"),
        (13, "ÄBCÄBCÄBCÄBCÄBCÄBCÄBC"), (14, "äbcäbcäbcäbcäbcäbcäbc"), (15, "äbcäbcäbcäbcäbcäbcäbc"),  # only A-Z fold
        (16, ""), (17, None), (18, "\n\n"), (None, None),
        (19, "\n".join([long] * 20_000 + ["y"])),
        (20, long),
    ]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, mark int")
    want = sorted(by_hand(rows), key=repr)
    assert (19, 20_001, 20_000, "y") in want and (20, 1, 0, long) in want
    assert got(docs.repartition(5)) == want
    assert got(docs, min_docs=2) == sorted(by_hand(rows, min_docs=2), key=repr)


def test_lines_of_null_ids_alone_stay(spark):
    docs = spark.createDataFrame([(None, "the very same line in all of them")] * 4, "doc_id long, text string")
    assert {(r[2], r[3]) for r in got(docs)} == {(0, "the very same line in all of them")}
    assert got(docs.limit(0)) == [] and rows_of(line_dedup.line_report(docs.limit(0))) == []


def test_hot_lines_give_the_same(spark, monkeypatch):
    """Whether a hash is joined by broadcast or by a shuffle makes no difference."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = got(docs)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    assert got(docs) == want
    monkeypatch.setattr(line_dedup, "HOT", 10**9)
    assert got(docs) == want
