"""Base counts against plain Python, and the verdict on clean and broken text."""

import random
import re

import public_tokenizers
import sentencepiece
from helpers import SMALL, rows_of

from askwell.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_base_counts_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in fertility.quality_report(docs, PATH).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for row in docs.collect():
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(row.text)
        assert r.n_tokens == sum(map(len, model.encode(WORD.findall(row.text))))
        assert not (r.kept and r.base_failed)


def test_odd_rows(spark):
    texts = [None, "", "\n\n", "a\na\n\na \nb", "é 漢字 ☃", " ".join(f"w{i}" for i in range(3000)), "a b c d e f\na b c d e f\n" * 30, "x" * 100_000, "\x0b\x0c\r\t q\x1cz"]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in fertility.quality_report(docs, PATH).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), text
    kept = fertility.kept_documents(docs, PATH)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5]
    assert rows_of(fertility.quality_report(docs.limit(0), PATH)) == []


def test_noise_is_rejected_and_prose_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    got = {r.doc_id: r for r in fertility.quality_report(docs, PATH).collect()}
    noisy = [got[r.doc_id] for r in docs.collect() if r.text.count("***") > 20]
    clean = [got[r.doc_id] for r in docs.collect() if not re.search(r"[#*$%&|<>]|!!", r.text) and not got[r.doc_id].base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert sum(r.kept for r in noisy) <= 0.6 * len(noisy)


def test_noise_is_rejected_in_each_language_and_length(spark):
    rng = random.Random(3)
    table = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").where("lang IN ('en', 'fr', 'es')").collect()
    clean = [(r.lang, r.text) for r in table if not re.search(r"[#*$%&|<>]|!!", r.text)]
    words = {lang: [w for l, t in clean if l == lang for w in t.split()] for lang in ("en", "fr", "es")}
    noisy = lambda lang, n: " ".join(w + (rng.choice(("###", "***", "&&&", "%%%", "$$$")) if rng.random() < 0.7 else "") for w in rng.choices(words[lang], k=n))
    rows = [(lang, text, False) for lang, text in clean]
    # Short, middle and far longer than any other text; in known languages and one that only these rows have.
    rows += [(lang, noisy(lang, n), True) for lang in words for n in (100, 400, 6_000) for _ in range(2)]
    rows += [("xx", noisy("en", n), True) for n in (300, 6_000)] + [("xx", " ".join(rng.choices(words["en"], k=300)), False)]
    docs = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in fertility.quality_report(docs, PATH).collect()}
    for lang in ("en", "fr", "es", "xx"):
        noise = [(got[i].n_words, got[i].multi_chars_per_token) for i, r in enumerate(rows) if r[0] == lang and r[2] and got[i].kept]
        assert not noise, (lang, noise)
        prose = [got[i].kept for i, r in enumerate(rows) if r[0] == lang and not r[2] and not got[i].base_failed]
        assert sum(prose) >= 0.95 * len(prose), lang
