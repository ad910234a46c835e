"""Quality rules by tokeniser fertility.

A public piece vocabulary is laid over each text's words and three things are measured: characters
per token, the share of byte-fallback tokens, and the entropy of the token distribution. A second,
multilingual vocabulary gives characters per token once more, as one vocabulary alone does not tell
noise from prose in languages that it knows little. Text that a vocabulary's language knows is cut
into tokens of a typical length; shouting, symbol noise, tables, keys and repeated lines are not.
Each language (for rows without one: the script of the first letter) and length class (powers of two
of tokens, as entropy grows with length) has a band around its quartiles, taken over all documents;
what lies outside is rejected. A length class of under ``SUPPORT`` documents cannot judge its own
rows: there the language's band over all lengths holds, wider for texts below the median length as the
error of a mean over fewer tokens is (for entropy, a fixed least value holds), and for languages of under ``SUPPORT`` documents the fixed limits of ``FIXED`` and ``MOST_SYMBOLS``.

Before that, plain base counts reject texts of under ``MIN_WORDS`` words and texts with over 20% of
their words in repeated five-word windows.

Each text is read once, in Arrow batches; recurring words are encoded once per worker. Only the
counts are shuffled, pre-aggregated into one row per band; the tables of bands are as large as there
are languages, and languages times length classes (at most 40).

Defined results: null or empty text has zero counts and is base_failed; repeated rows are judged
alike; a null lang uses the script; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import UnitCache, Words, documents, per_text, run_hashes, slices, text_bytes, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: A band reaches so many quartile ranges beyond the quartiles.
FENCE = 2.0
#: Least quartile range taken for each measure, so that a uniform group has a band at all.
FLOOR = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.25, "multi_chars_per_token": 0.05}
MEASURES = tuple(FLOOR)
#: Fewest documents from which a band is taken, limits for languages that have fewer, and their most symbols per character.
SUPPORT = 50
FIXED = {"chars_per_token": (0.25, 8.0), "byte_share": (0.0, 1.0), "entropy": (2.0, 64.0), "multi_chars_per_token": (0.25, 8.0)}
MOST_SYMBOLS = 0.2
#: The multilingual vocabulary, and the longest stretch of a word that it cuts at once.
MULTILINGUAL, STRETCH = "byte_bpe_multi_50k.tiktoken", 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = bytes(b in b"#*$%&|<>" for b in range(256))
_ADDED = "band string, size_class int, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[UnitCache, np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return UnitCache(lambda units: model.encode(units, num_threads=1)), is_byte


@lru_cache(maxsize=1)
def _multilingual(path: str) -> UnitCache:
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    model = tiktoken.Encoding("multilingual", pat_str=rf"(?s:.{{1,{STRETCH}}})", mergeable_ranks=ranks, special_tokens={})
    return UnitCache(lambda units: [model.encode_ordinary(u) for u in units])


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (owner, hash) occur twice or more."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    same = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    out = np.zeros(len(owner), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    data, at, n = words.data, words.at, words.n
    raw = data.tobytes()
    symbols = np.frombuffer(raw.translate(_SYMBOLS), bool)
    lead = (data & 0xC0) != 0x80
    first, hashes = words.windows(words.hashes(), WINDOW)
    twice = first[_repeated(words.owner[first], hashes)] if len(first) else first
    cover = np.zeros(len(words.starts) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = np.cumsum(cover)[: len(words.starts)] > 0
    # Lines with a word: from the byte after a line end (or the text's start) to the next line end.
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], ends[ends + 1 < len(data)] + 1]))
    owner = np.searchsorted(at, starts, "right") - 1
    next_end = np.append(ends, len(data))[np.searchsorted(ends, starts)]
    stops = np.minimum(next_end, at[owner + 1])
    solid = np.concatenate([[0], np.cumsum(words.solid)])
    worded = solid[stops] > solid[starts]
    starts, stops, owner = starts[worded], stops[worded], owner[worded]
    lines = run_hashes(data, starts, stops)
    order = np.lexsort((lines, owner))
    again = (owner[order][1:] == owner[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    return {
        "n_words": words.counts,
        "word_chars": per_text(words.solid & lead, at),
        "n_symbols": per_text(symbols, at),
        "n_dup_lines": np.bincount(owner[order][1:][again], minlength=n),
        "n_repeat_words": per_text(repeated, words.first),
    }


def _script(text: str | None) -> str:
    for c in text or "":
        if c.isalpha():
            return "script:" + unicodedata.name(c, "OTHER").split(" ")[0].lower()
    return "script:none"


def _token_measures(words: Words, path: str, multilingual: str) -> dict[str, np.ndarray]:
    cache, is_byte = _vocabulary(path)
    ids, sizes = cache.tokens(words.data, words.starts, words.ends)
    cut = np.concatenate([[0], np.cumsum(sizes)])[words.first]
    n = np.diff(cut)
    owner = np.repeat(np.arange(words.n), n)
    # entropy = log2(n) - sum(c * log2(c)) / n over the counts c of a text's distinct tokens
    keys = np.sort(owner << 32 | ids)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(keys)))
    spread = np.bincount(keys[edge] >> 32, counts * np.log2(np.maximum(counts, 1)), words.n) if len(keys) else np.zeros(words.n)
    some = np.maximum(n, 1)
    chars = per_text(words.solid & ((words.data & 0xC0) != 0x80), words.at)
    _, multi = _multilingual(multilingual).tokens(words.data, words.starts, words.ends)
    return {
        "n_tokens": n,
        "chars_per_token": chars / some,
        "byte_share": np.bincount(owner, is_byte[ids], words.n) / some,
        "entropy": np.log2(some) - spread / some,
        "multi_chars_per_token": chars / np.maximum(per_text(multi, words.first), 1),
    }


def _measurer(path: str):
    multilingual = public_tokenizers.path(MULTILINGUAL)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            words = Words(*text_bytes(text))
            found = base_counts(words) | _token_measures(words, path, multilingual)
            band = batch.column("lang").to_pylist()
            if None in band:
                band = [b if b is not None else _script(t) for b, t in zip(band, text.to_pylist())]
            sized = np.log2(np.maximum(found["n_tokens"], 1)).astype(np.int32)
            arrays = [*batch.columns, pa.array(band, pa.string()), pa.array(sized)]
            arrays += [pa.array(found[c].astype(np.int64)) for c in (*COUNTS, "n_tokens")] + [pa.array(found[c].astype(float)) for c in MEASURES]
            names = [f"c{i}" for i in range(len(arrays))]  # by position: names may clash
            yield pa.RecordBatch.from_arrays(arrays, names)

    return measure


def measured(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` as k0, k1, ..., and the counts and measures of each document."""
    spark = docs.sparkSession
    plain = documents(docs, *keep, *(c for c in ("text", "lang") if c not in keep))
    names = plain.columns
    plain = plain.withColumn("lang", F.col("lang").cast("string")) if "lang" not in keep else plain
    schema = [f"{f'k{i}'} {kind}" for i, (_, kind) in enumerate(plain.dtypes)]
    rows = plain.mapInArrow(_measurer(path), ", ".join(schema) + ", " + _ADDED)
    rows = rows.drop(*(f"k{i}" for i, n in enumerate(names) if n not in keep))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return written(rows.withColumn("base_failed", failed), "fertility")


def bands(rows: DataFrame, fence: float = FENCE) -> DataFrame:
    """Limits per band and size class, and per band alone (size class null), over all documents that the base rules let pass."""
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(m) for m in MEASURES]
    passed = rows.where("NOT base_failed")
    quartiles += [F.count("*").alias("n"), F.percentile_approx("n_tokens", F.lit(0.5), 1000).alias("typical")]
    whole = passed.groupBy("band").agg(*quartiles).withColumn("size_class", F.lit(None).cast("int"))
    found = passed.groupBy("band", "size_class").agg(*quartiles).unionByName(whole)
    limits = []
    for m in MEASURES:
        width = fence * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(FLOOR[m]))
        limits += [(F.col(m)[0] - width).alias(f"{m}_low"), (F.col(m)[1] + width).alias(f"{m}_high")]
    return found.where(F.col("n") >= SUPPORT).select("band", "size_class", "typical", *limits)


def judged(rows: DataFrame, fence: float = FENCE) -> DataFrame:
    """``measured`` rows with kept: false where a base rule fails or a measure leaves its band."""
    # Rows for each language and size class: bounded, whatever the documents.
    limits = written(bands(rows, fence), "bands")
    sides = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    cells = limits.where("size_class IS NOT NULL").select(F.col("band").alias("b"), F.col("size_class").alias("s"), *(F.col(c).alias(f"cell_{c}") for c in sides))
    whole = limits.where("size_class IS NULL").select(F.col("band").alias("w"), "typical", *(F.col(c).alias(f"all_{c}") for c in sides))
    out = rows.join(F.broadcast(cells), (F.col("band") == F.col("b")) & (F.col("size_class") == F.col("s")), "left")
    out = out.join(F.broadcast(whole), F.col("band") == F.col("w"), "left")
    unknown = F.col("b").isNull() & F.col("w").isNull()
    inside = ~unknown | (F.col("n_symbols") <= MOST_SYMBOLS * F.col("word_chars"))
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("typical") / F.greatest("n_tokens", F.lit(1))))
    for m in MEASURES:
        # Entropy grows with length, so that the band of all lengths says nothing of it.
        middle, reach = (F.col(f"all_{m}_high") + F.col(f"all_{m}_low")) / 2, wider * (F.col(f"all_{m}_high") - F.col(f"all_{m}_low")) / 2
        whole_low, whole_high = (F.lit(None), F.lit(None)) if m == "entropy" else (middle - reach, middle + reach)
        low = F.coalesce(f"cell_{m}_low", whole_low, F.lit(FIXED[m][0]))
        high = F.coalesce(f"cell_{m}_high", whole_high, F.lit(FIXED[m][1]))
        # Too varied a text is no fault, nor is one without byte tokens.
        inside = inside & (F.col(m) <= high if m == "byte_share" else F.col(m) >= low if m == "entropy" else F.col(m).between(low, high))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def quality_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures behind the verdict."""
    rows = judged(measured(docs, path, ["doc_id"]))
    return rows.select(F.col("k0").alias("doc_id"), *COUNTS, "base_failed", "kept", "band", "n_tokens", *MEASURES)


def kept_documents(docs: DataFrame, path: str) -> DataFrame:
    """The documents that pass, with their own columns."""
    names = docs.columns
    rows = judged(measured(docs, path, names)).where("kept")
    return rows.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)))
