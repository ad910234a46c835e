"""Quality classifier: an interpolated modified Kneser-Ney model over trusted text.

The model is over the bytes of the text (order ``ORDER``, with a mark before each text), so an n-gram is a
whole number. Trusted texts are counted in their tasks and the counts summed by n-gram; all further
tables are counts of counts and joins by n-gram or context, dealt over the cluster: continuation
counts, the three discounts of each order, the interpolation weight of each context, and the
probability of each n-gram. The n-grams of the documents get their probabilities by joins with these
tables, order by order; an n-gram or context that wasn't seen takes the lower order's.

Texts are dealt into ``FOLDS`` by their hash, so equal texts are in one. There is a model for each fold, of
the trusted texts in the others, and it scores the fold's documents: no text is scored by a model that has
seen it, and the thresholds come from held-out texts alone. An n-gram's number holds its model's.

The n-grams that any document holds are found first, in one pass, and all orders' joins start from that table.
Documents are dealt once into blocks of about ``BLOCK_BYTES`` of text, each of one fold. A block's texts meet
the probabilities of the n-grams that occur in them, and of no others. A document is kept if its perplexity
is at most the ``QUANTILE`` of its language's trusted documents.

A frequent n-gram is one row per task before any shuffle, and one row per block after it.

Defined results: null and empty texts have no perplexity and are not kept; a language without trusted
documents takes the quantile over all of them; without any trusted text all with text are kept; if all
trusted texts are in one fold, there is one model of them for all documents; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import discard, documents, settled, slices, text_bytes, written

ORDER = 5
QUANTILE = 0.995
BLOCK_BYTES = 32 << 20
FOLDS = 2
MODEL_BITS = 48  # an n-gram's number holds the number of its model from this bit on
HELD = 4_000_000  # n-grams that a task holds of a model
START = 255  # never a byte of UTF-8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of the texts, the n-gram that ends with it, as a number."""
    full = at[:-1] < at[1:]
    padded = np.insert(data, np.repeat(at[:-1][full], ORDER - 1), START).astype(np.int64)
    n = len(data) + (ORDER - 1) * int(full.sum())
    last = max(n - ORDER + 1, 0)
    keys = np.zeros(last, np.int64)
    for j in range(ORDER):
        keys = keys << 8 | padded[j : last + j]
    inside = np.ones(last, bool)  # n-grams don't cross texts
    begins = (at[:-1] + (ORDER - 1) * (np.cumsum(full) - full))[full]
    for j in range(1, ORDER):
        cross = begins[1:] - j
        inside[cross[cross < last]] = False
    return keys[inside]


class Lookup:
    """Row of each key, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rows, place = np.arange(len(keys), dtype=np.int32), self._place(self.keys)
        while len(rows):
            free = self.slots[place] < 0
            self.slots[place[free]] = rows[free]
            on = self.slots[place] != rows
            rows, place = rows[on], (place[on] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        place = self._place(keys)
        out = self.slots[place]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & self.mask
            out[wrong] = self.slots[place[wrong]]
            if (out[wrong] < 0).any():
                raise KeyError("an n-gram without a probability")
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        return out


_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle: two thirds of what a shuffle makes of them itself."""
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        raw = data.tobytes()
        packed = [_CODEC.compress(raw[a:b], asbytes=True) if b > a else b"" for a, b in zip(at.tolist(), at[1:].tolist())]
        rows = [*batch.columns[:-1], pa.array(np.diff(at)), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, [*batch.schema.names[:-1], "n_bytes", "packed"])


def _unpacked(packed, sizes, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and places of the texts, about ``most`` bytes at a time."""
    held, at = [], [0]
    for raw, n in zip(packed, sizes):
        held.append(_CODEC.decompress(raw, int(n), asbytes=True) if n else b"")
        at.append(at[-1] + int(n))
        if at[-1] >= most:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(at)
            held, at = [], [0]
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(at)


def _count(folds: int):
    """The n-grams of trusted texts, for the models that learn from their fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(of).tolist():
                texts = batch.column("text").filter(pa.array(of == fold))
                grams, n = np.unique(gram_keys(*text_bytes(texts)), return_counts=True)
                for model in range(folds):
                    if model != fold or folds == 1:
                        rows = [pa.array(grams | model << MODEL_BITS), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(rows, ["gram", "n"])

    return count


def _block_grams(folds: int):
    """The distinct n-grams of each block; all of a block's rows are in one task, and of one fold."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                own = batch.filter(pa.array(blocks == block))
                for data, at in _unpacked(own.column("packed").to_pylist(), own.column("n_bytes").to_numpy()):
                    grams = np.unique(gram_keys(data, at))
                    held[block] = np.union1d(held[block], grams) if block in held else grams
        for block, grams in held.items():
            for i in range(0, len(grams), 100_000):
                part = grams[i : i + 100_000] | block % folds << MODEL_BITS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part)], ["block", "gram"])

    return distinct


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of all texts with the numbers of their models: a task's are made distinct, ``HELD`` at a time."""

    def rows(fold: int, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 100_000] | fold << MODEL_BITS)], ["gram"])

    held: dict[int, list[np.ndarray]] = {}
    for batch in slices(batches):
        of = batch.column("fold").to_numpy(zero_copy_only=False)
        for fold in np.unique(of).tolist():
            texts = batch.column("text").filter(pa.array(of == fold))
            held.setdefault(fold, []).append(np.unique(gram_keys(*text_bytes(texts))))
            if sum(map(len, held[fold])) > HELD:
                held[fold] = [np.unique(np.concatenate(held[fold]))]
                if len(held[fold][0]) > HELD // 2:
                    yield from rows(fold, held.pop(fold)[0])
    for fold, parts in held.items():
        yield from rows(fold, np.unique(np.concatenate(parts)))


def _model(gram: str) -> F.Column:
    """The number of an n-gram's model, in its place."""
    return F.col(gram).bitwiseAND(F.lit(-1 << MODEL_BITS))


def _tail(gram: str, order: int) -> F.Column:
    """The last ``order`` bytes, in the same model."""
    return F.col(gram).bitwiseAND(F.lit(-1 << MODEL_BITS | (1 << (8 * order)) - 1))


def _context(gram: str) -> F.Column:
    """All but the last byte, in the same model."""
    return F.shiftright(F.col(gram).bitwiseAND(F.lit((1 << MODEL_BITS) - 1)), 8).bitwiseOR(_model(gram))


def _per_model(values: dict[int, float], other: float) -> F.Column:
    """A number for each model (there are ``FOLDS`` at most)."""
    out = F.lit(other)
    for model, value in values.items():
        out = F.when(_model("gram") == model, F.lit(value)).otherwise(out)
    return out


def _discounts(ones: float, twos: float, threes: float, fours: float) -> list[float]:
    """What is taken off n-grams seen once, twice, and more often, from how many were seen so often."""
    t = (ones, twos, threes, fours)
    y = ones / (ones + 2 * twos) if ones else 0.0
    return [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k] / t[k - 1])) if t[k - 1] else 0.5 for k in (1, 2, 3)]


def language_model(trusted: DataFrame, folds: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order: (gram, p) of the seen n-grams, and (ctx, back, kinds) of the seen contexts, of all models.

    Order 1 is smoothed with one equal share for each of its symbols and one for the unseen.
    """
    top = trusted.mapInArrow(_count(folds), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {ORDER: written(top, "kn-counts")}
    for order in range(ORDER - 1, 0, -1):  # how many symbols an n-gram was seen after
        above = counts[order + 1].select(_tail("gram", order).alias("gram"))
        counts[order] = written(above.groupBy("gram").agg(F.count("*").alias("n")), "kn-counts")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(1, ORDER + 1):
        table = counts[order]
        often = (F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4))
        cuts = {r[0]: _discounts(*r[1:]) for r in table.groupBy(_model("gram")).agg(*often).collect()}
        once, twice, more = (_per_model({m: c[k] for m, c in cuts.items()}, 0.0) for k in (0, 1, 2))
        cut = F.when(F.col("n") == 1, once).when(F.col("n") == 2, twice).otherwise(more)
        table = table.withColumn("ctx", _context("gram")).withColumn("cut", cut)
        sums = table.groupBy("ctx").agg(F.sum("n").alias("all"), F.sum("cut").alias("off"), F.count("*").alias("kinds"))
        weights = written(sums.select("ctx", "all", "kinds", (F.col("off") / F.col("all")).alias("back")), "kn-contexts")
        own = table.join(weights, "ctx").withColumn("own", (F.col("n") - F.col("cut")) / F.col("all"))
        if order == 1:
            p = own.select("gram", (F.col("own") + F.col("back") / (F.col("kinds") + 1)).alias("p"))
        else:
            lower = model[order - 1][0].select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            p = own.withColumn("tail", _tail("gram", order - 1)).join(lower, "tail")
            p = p.select("gram", (F.col("own") + F.col("back") * F.col("low")).alias("p"))
        model[order] = written(p, "kn-probabilities"), weights.select("ctx", "back", "kinds")
    return model


def probabilities(grams: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, p for distinct n-grams: the seen probability, or what the lower orders leave.

    A lower order's are found for the distinct ends of the n-grams: these are far fewer, and travel instead of them.
    """
    asked = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        asked[order] = asked[order + 1].select(_tail("gram", order).alias("gram")).distinct()
    unseen = {r.ctx: r.back / (r.kinds + 1) for r in model[1][1].collect()}  # one row per model
    out = asked[1].join(model[1][0].withColumnRenamed("p", "seen"), "gram", "left")
    out = out.select("gram", F.coalesce("seen", _per_model(unseen, 1.0)).alias("p"))
    for order in range(2, ORDER + 1):
        p, weights = model[order]
        own = asked[order].join(p.withColumnRenamed("p", "seen"), "gram", "left")
        own = own.withColumn("c", _context("gram")).join(weights.select(F.col("ctx").alias("c"), "back"), "c", "left")
        own = own.select("gram", "seen", "back", _tail("gram", order - 1).alias("g"))
        left = F.coalesce("back", F.lit(1.0)) * F.col("p")
        out = own.join(out.select(F.col("gram").alias("g"), "p"), "g").select("gram", F.coalesce("seen", left).alias("p"))
    return out


def _scored(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Mean negative log probability of a byte of each text of a block."""
    table = table[table["gram"].notna()]
    table = table.assign(gram=table["gram"].to_numpy(np.int64) & (1 << MODEL_BITS) - 1)  # all of one model
    known, cost = Lookup(table["gram"].to_numpy(np.int64)), -table["p"].to_numpy(float)
    totals = []
    for data, at in _unpacked(docs["packed"], docs["n_bytes"]):
        keys = gram_keys(data, at)
        costs = cost[known.rows(keys)] if len(keys) else np.zeros(0)
        totals.append(np.diff(np.concatenate([[0], np.cumsum(costs)])[at]))
    n = docs["n_bytes"].to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (np.concatenate(totals) if totals else np.zeros(0)) / n
    return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "lang": docs["lang"].to_numpy(), "n_bytes": n, "nll": mean})


def perplexities(docs: DataFrame, trusted_ids: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, nll (mean negative log probability of a byte), trusted."""
    spark = docs.sparkSession
    plain = documents(docs, "doc_id", "text", "lang").withColumn("lang", F.col("lang").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    trust = trusted_ids.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id IS NOT NULL")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS))
    # Spark's own Bloom filter keeps texts that aren't trusted out of this join's shuffle.
    bloom = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(bloom)
    spark.conf.set(bloom, "1b")
    try:
        trusted = plain.join(trust, F.col("doc_id") == F.col("t_id"), "left_semi").where("text != ''")
        trusted = written(trusted.select("text", fold.alias("fold")), "kn-trusted")
    finally:
        spark.conf.set(bloom, before)
    folds = FOLDS if len(trusted.select("fold").distinct().collect()) == FOLDS else 1  # FOLDS rows at most
    model = language_model(trusted, folds)
    discard(spark, "kn-trusted", "kn-counts")  # the trusted texts, and counts: nothing reads them any more
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (block_bytes * folds)))
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(parts)) * folds + F.pmod(F.xxhash64("text"), F.lit(folds))
    keyed = plain.select("doc_id", "lang", block.alias("block"), "text")
    dealt = keyed.mapInArrow(_pack, "doc_id long, lang string, block long, n_bytes long, packed binary").repartition(parts * folds, "block")
    grams = dealt.mapInArrow(_block_grams(folds), "block long, gram long")
    # All orders start from this table: from the blocks, each of them would cut all texts into n-grams again.
    own = plain.select(F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"), "text")
    asked = written(own.mapInArrow(_text_grams, "gram long").distinct(), "kn-asked")
    known = probabilities(asked, model)
    table = grams.join(known.select("gram", F.log("p").cast("float").alias("p")), "gram").select("block", "gram", "p")
    out = dealt.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(_scored, "doc_id long, lang string, n_bytes long, nll double")
    out = out.join(trust.distinct(), F.col("doc_id") == F.col("t_id"), "left")
    return out.select("doc_id", "lang", "n_bytes", "nll", F.col("t_id").isNotNull().alias("trusted"))


def classified(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (of a byte), threshold, kept."""
    scored = settled(lambda: perplexities(docs, trusted_ids), docs.sparkSession, "perplexities")
    trusted = scored.where("trusted AND n_bytes > 0")
    cut = F.percentile_approx("nll", F.lit(quantile), 10_000)
    per_language = trusted.where("lang IS NOT NULL").groupBy(F.col("lang").alias("l")).agg(cut.alias("own"))
    overall = trusted.agg(cut).first()[0]
    out = scored.join(F.broadcast(per_language), F.col("lang") == F.col("l"), "left")  # one row per language
    limit = F.coalesce("own", F.lit(overall).cast("double"), F.lit(float("inf")))
    has = F.col("n_bytes") > 0
    return out.select(
        "doc_id", "lang", "n_bytes", F.when(has, F.exp("nll")).alias("perplexity"), F.exp(limit).alias("threshold"),
        (has & (F.col("nll") <= limit)).alias("kept"),
    )
