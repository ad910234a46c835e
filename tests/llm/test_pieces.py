"""Encoding against a plain Viterbi over all pieces; decoding gives the text back."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import SMALL, rows_of

from askwell.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best_score(model, scores, unit):
    best = [0.0] + [-1e18] * len(unit)
    for i in range(1, len(unit) + 1):
        best[i] = best[i - 1] + model.fallback
        for n in range(1, min(i, 16) + 1):
            s = scores.get(unit[i - n : i])
            if s is not None:
                best[i] = max(best[i], best[i - n] + s)
    return best[-1]


def test_best_segmentation():
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = pieces.read_model(PATH)
    file = proto.ModelProto()
    file.ParseFromString(open(PATH, "rb").read())
    scores = {p.piece: p.score for p in file.pieces if p.type == 1}
    rng = np.random.default_rng(2)
    for n in range(200):
        text = " " + "".join(rng.choice(list("aeinorstlhdé漢"), rng.integers(1, 25)))
        ids = model.encode_unit(text)
        unit = text.replace(" ", pieces.MARK)
        got = 0.0
        fallen = sum(i in model.byte_of for i in ids)
        got += sum(scores[model.pieces[i]] for i in ids if i not in model.byte_of)
        assert fallen == sum(len(c.encode()) for c in unit if c not in scores)
        got += model.fallback * sum(c not in scores for c in unit)
        assert abs(got - best_score(model, scores, unit)) < 1e-3


def test_units_do_not_change_the_result():
    model, _ = pieces.model_cache(PATH)
    texts = ["", " ", "a", "  two  spaces ", "line\nend\n\n", "é▁q ☃ 漢字", "\x00\x01", "x" * 3000, "tab\tand\rreturn"]
    ids, counts = pieces.encode_texts(pa.array(texts + [None]), PATH)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == (model.encode_unit(" " + text) if text else [])
        assert model.decode(own) == text


def test_round_trip_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens = pieces.encode_documents(docs, PATH)
    back = dict(rows_of(pieces.decode_documents(tokens, PATH)))
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip for r in pieces.encoding_report(docs, PATH).collect())


def test_marks_of_the_text_are_not_spaces(spark):
    texts = ["a▁b", "▁", "▁▁ ▁", " ▁a", "a b▁", "a\n▁b", "▁" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(rows_of(pieces.decode_documents(pieces.encode_documents(docs, PATH), PATH))) == dict(enumerate(texts))
    assert all(r.round_trip for r in pieces.encoding_report(docs, PATH).collect())
    model, _ = pieces.model_cache(PATH)
    assert [model.bytes_of(i) for i in model.encode_unit("▁")] == [b"\xe2", b"\x96", b"\x81"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, tokens int")
    got = rows_of(pieces.encode_documents(docs, PATH))
    assert (1, None) in got and got.count((2, [])) == 2
    assert rows_of(pieces.decode_documents(pieces.encode_documents(docs, PATH), PATH)).count((None, "a b")) == 1
    assert rows_of(pieces.encoding_report(docs.limit(0), PATH)) == []
