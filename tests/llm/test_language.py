"""Phrases against a plain greedy parse, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, rows_of

from askwell.llm import language
from askwell.llm.common import text_bytes


def greedy(text, sample):
    raw, known, n = text.encode(), sample.encode(), 0
    for cut in range(0, len(raw), language.STRETCH):
        part, i = raw[cut : cut + language.STRETCH], 0
        while i < len(part):
            size = 1
            while i + size < len(part) and part[i : i + size + 1] in known:
                size += 1
            i += size
            n += 1
    return n


def test_phrases():
    rng = np.random.default_rng(4)
    word = lambda kinds, n: "".join(rng.choice(list(kinds), n))
    samples = {"x": word("abcé ", 400), "y": word("bcdü ", 300), "z": "q"}
    texts = [word("abcdéü z", n) for n in (0, 1, 7, 511, 512, 513, 1500)] + [samples["x"][30:200]]
    parser = language.CrossParser(samples)
    got = parser.phrases(*text_bytes(pa.array(texts)))
    assert got.tolist() == [[greedy(t, samples[s]) for s in ("x", "y", "z")] for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    rows = docs.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (6, "123 !!", "fr"), (None, "the dog", None), (8, "die Katze " * 20_000, None), (9, "the cat", "en"), (9, "the cat", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    assert (got[3].lang_pred, got[4].lang_pred, got[6].lang_pred) == ("und", "und", "und") and got[3].score == 0
    learned = {lang for i, _, lang in rows if i is not None and lang and zlib.crc32(str(i).encode()) % 5}
    assert {r.lang_pred for r in got.values()} <= learned | {"und"}
    if {"en", "de"} <= learned:
        assert got[8].lang_pred == "de" and got[None].lang_pred == "en"
    assert {r.lang_pred for r in language.identified(docs.drop("lang")).collect()} == {"und"}
    assert rows_of(language.identified(docs.limit(0))) == []


def test_the_sample_is_taken_from_whole_texts(spark):
    rows = [(i, "a " * 1000 + "b " * 1000 + "c " * 1000, "xx") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.labelled_sample(docs)["xx"]
    assert {"a", "b", "c"} <= set(sample) and sample == language.labelled_sample(docs.repartition(5))["xx"]
    assert all(len(part) <= language.SAMPLE_CHARS for part in sample.split("\n"))


@pytest.mark.parametrize("symbols", [1, 2, 30, 240])
def test_pooled_moves_are_the_automatas(symbols):
    random = np.random.default_rng(symbols)
    automata = [language.SuffixAutomaton(random.integers(0, symbols, n).astype(np.uint8).tobytes()).moves for n in (0, 1, 700, 3000)]
    width = symbols + 1
    pool = language.Moves(automata, width)
    for root, moves in zip(pool.roots, automata):
        for symbol in range(width):
            want = [root + row[symbol] if symbol in row else -1 for row in moves]
            assert pool.after(root + np.arange(len(moves)), np.full(len(moves), symbol)).tolist() == want
    held = sum(len(row) for moves in automata for row in moves)
    assert len(pool.owner) <= 2 * held + 8 * width
