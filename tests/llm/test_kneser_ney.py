"""Perplexities against a plain interpolated modified Kneser-Ney model."""

import math
from collections import Counter
from uuid import uuid4

import pyarrow as pa
from helpers import SMALL, rows_of
from pyspark.sql import functions as F

from askwell.llm import kneser_ney
from askwell.llm.kneser_ney import ORDER


def grams(raw):
    padded = bytes([255]) * (ORDER - 1) + raw
    return [padded[i : i + ORDER] for i in range(len(raw))]


class Plain:
    def __init__(self, texts):
        self.counts = {ORDER: Counter(g for t in texts for g in grams(t))}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.cuts, self.context = {}, {}
        for n, table in self.counts.items():
            t = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
            self.cuts[n] = [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k] / t[k - 1])) if t[k - 1] else 0.5 for k in (1, 2, 3)]
            for g, c in table.items():
                have = self.context.setdefault(g[:-1], [0, 0.0, 0])
                have[0] += c
                have[1] += self.cuts[n][min(c, 3) - 1]
                have[2] += 1

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (self.context[b""][2] + 1)
        low = self.p(gram[1:])
        if gram[:-1] not in self.context:
            return low
        total, off, _ = self.context[gram[:-1]]
        c = self.counts[n].get(gram, 0)
        return (c - self.cuts[n][min(c, 3) - 1] if c else 0) / total + off / total * low


def test_against_a_plain_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").select("doc_id")
    trusted = {r.doc_id for r in labels.collect()}
    rows = {r.doc_id: r for r in docs.withColumn("fold", F.expr(f"pmod(xxhash64(text), {kneser_ney.FOLDS})")).collect()}
    own = [rows[i] for i in sorted(trusted) if i in rows]
    models = {f: Plain([r.text.encode() for r in own if r.fold != f]) for f in range(kneser_ney.FOLDS)}  # held out
    setting = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(setting)
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels, block_bytes=100_000).collect()}
    assert spark.conf.get(setting) == before
    assert set(got) == set(rows)
    known = {}
    for i, row in list(rows.items())[::9]:
        raw = row.text.encode()
        cost = 0.0
        for g in grams(raw):
            if (row.fold, g) not in known:
                known[row.fold, g] = -math.log(models[row.fold].p(g))
            cost += known[row.fold, g]
        assert abs(got[i].nll - cost / len(raw)) < 1e-5 and got[i].trusted == (i in trusted)
    model = models[0]
    seen = [c for c in range(256) if bytes([c]) in model.counts[1]]
    unseen = next(c for c in range(256) if c not in seen)  # one share for all of them
    assert abs(sum(model.p(b"the " + bytes([c])) for c in [*seen, unseen]) - 1) < 1e-9


def test_thresholds(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    got = {r.doc_id: r for r in kneser_ney.classified(docs, labels.where("quality = 1").select("doc_id")).collect()}
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect() if r.doc_id in got]
    noisy = [got[r.doc_id] for r in docs.collect() if r.text.count("***") > 20 or r.text.count("!!") > 20]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and not any(r.kept for r in noisy)


def test_a_text_is_scored_by_a_model_that_has_not_seen_it(spark):
    """A trusted text of words of its own costs as much as without its label."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "qzx jvkq wqzj xkvq zzqj kxwv " * 30, "en")], docs.schema)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").select("doc_id")
    both = labels.union(spark.createDataFrame([(-1,)], labels.schema))
    with_label, without = (kneser_ney.perplexities(docs.union(odd), ids).where("doc_id = -1").first() for ids in (both, labels))
    assert with_label.trusted and not without.trusted and abs(with_label.nll - without.nll) < 1e-6


def test_odd_rows(spark):
    rows = [(1, "abab abab", "en"), (2, None, "en"), (3, "", None), (4, "zzzz", None), (None, "abab", "de"), (5, "漢字 é \x00", "en"), (6, "ab " * 100_000, "fr"), (1, "abab abab", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, gram int")
    one = spark.createDataFrame([(1,)], "doc_id long")
    got = rows_of(kneser_ney.classified(docs, one).select("doc_id", "perplexity", "kept"))
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows) and by[2] == (None, False) and by[3] == (None, False) and by[1][1] and by[4][0] > by[1][0]
    assert all(r[2] for r in rows_of(kneser_ney.classified(docs, one.limit(0)).select("doc_id", "n_bytes", "kept")) if r[1])
    assert rows_of(kneser_ney.classified(docs.limit(0), one)) == []


def test_trusted_texts_and_counts_are_not_kept_while_documents_are_scored(spark, monkeypatch, tmp_path):
    """Scratch tables that nothing reads any more take no disk when the documents' n-grams are joined."""
    root, seen = f"{tmp_path}/scratch", []
    monkeypatch.setattr("askwell.llm.common.scratch_path", lambda session, name: f"{root}/{name}-{len(list(tmp_path.glob('scratch/*'))):032x}")
    plain = kneser_ney.probabilities
    monkeypatch.setattr(kneser_ney, "probabilities", lambda *a: seen.extend(p.name.rpartition("-")[0] for p in tmp_path.glob("scratch/*")) or plain(*a))
    rows = [(i, f"some words {i % 3} and more {i} of them", "en") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert kneser_ney.classified(docs, docs.where("doc_id < 6").select("doc_id")).where("kept").count()
    assert "kn-probabilities" in seen and not {"kn-trusted", "kn-counts"} & set(seen)
    assert [p.name.rpartition("-")[0] for p in tmp_path.glob("scratch/*")] == ["perplexities"]


def test_texts_are_cut_into_ngrams_once(spark, monkeypatch, tmp_path):
    """Each block's n-grams are found in one pass, and not again for each order."""
    plain = kneser_ney._block_grams

    def noted(folds):
        cut = plain(folds)

        def run(batches):
            def marked():
                for batch in batches:
                    for block in set(batch.column("block").to_pylist()):
                        (tmp_path / f"{block}-{uuid4().hex}").touch()
                    yield batch

            return cut(marked())

        return run

    monkeypatch.setattr(kneser_ney, "_block_grams", noted)
    rows = [(i, f"some words {i % 3} and more {i} of them", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = kneser_ney.perplexities(docs, docs.where("doc_id < 20").select("doc_id"), block_bytes=200)
    assert len(out.collect()) == 40
    blocks = [p.name.partition("-")[0] for p in tmp_path.iterdir()]
    assert len(blocks) > 2 and len(blocks) == len(set(blocks))


def test_a_task_holds_few_ngrams(monkeypatch):
    monkeypatch.setattr(kneser_ney, "HELD", 40)
    texts, folds = [f"text {i * 7919} of words" for i in range(50)] + [None, ""], [i % 2 for i in range(52)]
    batch = pa.RecordBatch.from_arrays([pa.array(folds, pa.int64()), pa.array(texts, pa.string())], ["fold", "text"])
    out = list(kneser_ney._text_grams(iter([batch.slice(i, 4) for i in range(0, 52, 4)])))
    want = {int.from_bytes(g, "big") | f << kneser_ney.MODEL_BITS for t, f in zip(texts, folds) for g in grams((t or "").encode())}
    assert len(out) > 4 and {g for b in out for g in b.column("gram").to_pylist()} == want
