"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

Documents are read once into postings: per document its number of terms, and the asked terms it holds with
their counts, one row per document, written where the document lay. From these come the numbers of
documents and terms and the document frequencies. Each task then takes its documents' postings in bounded
portions, turns a portion into lists per term, and answers each question over these lists, rarest term
first. A document gets an accumulator at its first term, until what the remaining terms can add at most
is below the k-th best score (of this portion so far, or of the portions before); from there on only
documents that have an accumulator are updated, with all their terms. So the scores are exact, and no
document that belongs to the best k is left out; equal scores stay open, as the smaller doc_id wins.

A task sends at most k rows per question; these are ranked in two stages. Questions are taken in blocks
whose terms are bounded in number (``BLOCK_TERMS``), each block with one pass over the texts; the driver
and the tasks hold the terms of one block.

Score of a document for a question, in 64-bit integers (``div`` rounds down): the sum over the question's
terms, repeats included, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``, where
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 25 + (75 * n * N) div L``.

Defined results: null or empty text has no terms; a question without terms, or whose terms no document
holds, has no hits; repeated questions are answered each, repeated documents are hits each; a null doc_id
comes after all others among equal scores; no documents or no questions give no rows; other columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import byte_runs, documents, run_hashes, settled, slices, text_bytes, written
from askwell.session import scratch_path

K = 10
#: Terms of all questions of a block together.
BLOCK_TERMS = 250_000
#: Postings, and documents, of a portion that is searched at once.
PORTION, PORTION_DOCS = 1_000_000, 65_536
LANES = 64

_TERM_BYTE = bytes(b > 0x7F or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256))
_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
_NONE = np.iinfo(np.int64).max  # a null doc_id


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text in order."""
    raw = (text or "").encode().lower()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = byte_runs(data, np.array([0, len(data)]), _TERM_BYTE)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """Numbers of known terms, found by hash, length and first eight bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(terms)]
        keys = run_hashes(data, starts, ends)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.sizes = (ends - starts)[self.order]
        self.heads = self._heads(data, starts, ends)[self.order]

    @staticmethod
    def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        heads = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))[starts].astype(np.uint64)
        short = ends - starts < 8
        heads[short] &= (np.uint64(1) << (8 * (ends - starts)[short]).astype(np.uint64)) - np.uint64(1)
        return heads

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ranges are known terms, and their numbers."""
        if not len(self.keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = run_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == keys)
        at = at[rows]
        same = (self.sizes[at] == (ends - starts)[rows]) & (self.heads[at] == self._heads(data, starts[rows], ends[rows]))
        return rows[same], self.order[at[same]]


@dataclass
class Block:
    """Questions of a block: their ids, and (number of the term, times asked) per question."""

    ids: pa.Array
    asked: list[list[tuple[int, int]]]
    terms: list[bytes]


def _block(rows: pa.Table) -> Block:
    numbers: dict[bytes, int] = {}
    asked = []
    for text in rows.column("text").to_pylist():
        counts = Counter(terms_of(text))
        asked.append([(numbers.setdefault(t, len(numbers)), c) for t, c in counts.items()])
    return Block(rows.column("item_id").combine_chunks(), asked, list(numbers))


def _postings(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value.terms)
        size = max(len(vocabulary.keys), 1)
        for part in slices(batches):
            data, at = text_bytes(part.column("text"))
            data = np.frombuffer(data.tobytes().lower(), np.uint8)
            starts, ends, owner = byte_runs(data, at, _TERM_BYTE)
            n = np.bincount(owner, minlength=part.num_rows)
            rows, numbers = vocabulary.find(data, starts, ends)
            cells, tfs = np.unique(owner[rows] * size + numbers, return_counts=True)
            some = np.flatnonzero(n)
            begins = np.searchsorted(cells, np.append(some, part.num_rows) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(some)),
                    pa.array(n[some].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(begins), pa.array((cells % size).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(begins), pa.array(tfs.astype(np.int32))),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return read


def _frequencies(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for part in batches:
            df += np.bincount(part.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    return count


def term_weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a unit of weight adds, for counts ``tf`` in documents of ``n`` terms."""
    if len(n) and int(n.max()) * 75 * docs >= 2**63:  # exact beyond 64 bits too
        m = 25 + (n.astype(object) * 75 * docs // words).astype(np.int64)
    else:
        m = 25 + 75 * n.astype(np.int64) * docs // words
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Portion:
    """The postings of some documents by term, and the search over them."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, terms: np.ndarray, impact: np.ndarray, size: int):
        order = np.argsort(terms, kind="stable")
        self.ids, self.docs, self.impact = ids, owner[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        full = self.bounds[:-1] < self.bounds[1:]
        if full.any():
            self.most[full] = np.maximum.reduceat(self.impact, self.bounds[:-1][full])

    def best(self, asked: list[tuple[int, int]], k: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the best ``k`` documents, of those above 0 that reach ``limit``, and how many got accumulators.

        ``asked``: (term, weight) with the rarest term first.
        """
        asked = [(t, w) for t, w in asked if w > 0 and self.most[t] > 0]
        left = np.cumsum([w * int(self.most[t]) for t, w in reversed(asked)])[::-1].tolist() + [0]
        scores, held = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        top, open_ = 0, True
        for i, (t, w) in enumerate(asked):
            rows = self.docs[self.bounds[t] : self.bounds[t + 1]]
            gain = w * self.impact[self.bounds[t] : self.bounds[t + 1]]
            if open_ and top > left[i]:  # the k-th best can't be far: look it up
                partial = scores[held]
                if len(partial) >= k:
                    limit = max(limit, int(np.partition(partial, -k)[-k]))
            open_ = open_ and limit <= left[i]
            if not open_:
                known = held[rows]
                rows, gain = rows[known], gain[known]
            scores[rows] += gain
            held[rows] = True
            top = max(top, int(scores[rows].max(initial=0)))
        found = np.flatnonzero(held)
        value = scores[found]
        if len(value) > k:
            limit = max(limit, int(np.partition(value, -k)[-k]))
        near = value >= max(limit, 1)
        found, value = found[near], value[near]
        order = np.lexsort((self.ids[found], -value))[:k]
        return value[order], self.ids[found][order], int(held.sum())


def _searched(shared, df: np.ndarray, docs: int, words: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        size = len(df)
        weight = [term_weight(int(d), docs) for d in df]
        asked = [[(t, c * weight[t]) for t, c in sorted(q, key=lambda tc: (df[tc[0]], tc[0]))] for q in block.asked]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]

        def take(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts)
            ids = whole.column("doc_id").fill_null(_NONE).to_numpy()
            n = whole.column("n").to_numpy()
            lists = whole.column("terms").combine_chunks()
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            tfs = whole.column("tfs").combine_chunks().flatten().to_numpy()
            portion = Portion(ids, owner, lists.flatten().to_numpy(), impacts(tfs, n[owner], docs, words), size)
            for q, terms in enumerate(asked):
                score, held = best[q]
                limit = int(score[-1]) if len(score) == k else 0
                more, found, _ = portion.best(terms, k, limit)
                if len(more):
                    score, held = np.append(score, more), np.append(held, found)
                    order = np.lexsort((held, -score))[:k]
                    best[q] = score[order], held[order]

        parts, cells, rows = [], 0, 0
        for part in batches:
            parts.append(part)
            cells += len(part.column("terms").flatten())
            rows += part.num_rows
            if cells >= PORTION or rows >= PORTION_DOCS:
                take(parts)
                parts, cells, rows = [], 0, 0
        if rows:
            take(parts)
        number = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        score = np.concatenate([s for s, _ in best] or [np.zeros(0, np.int64)])
        ids = np.concatenate([d for _, d in best] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.astype(np.int32)), block.ids.take(pa.array(number)), pa.array(ids, mask=ids == _NONE), pa.array(score)],
            names=["place", "item_id", "doc_id", "score"],
        )

    return search


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each question; those of one lane first, so that no window holds the hits of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = hits.withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(LANES)))
    few = dealt.withColumn("rank", F.row_number().over(W.partitionBy("place", "lane").orderBy(*order)))
    few = few.where(F.col("rank") <= k).drop("rank", "lane")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each question. ``items``: item_id, text."""
    spark = docs.sparkSession
    plain = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    questions = documents(items, "item_id", "text")
    kind = questions.schema["item_id"].dataType.simpleString()

    def make() -> DataFrame:
        # At most as many terms as bytes, plus one, over two.
        total = questions.agg(F.sum(F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2))).first()[0] or 0
        blocks = max(-(-int(total) // BLOCK_TERMS), 1)
        place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        out, sizes = scratch_path(spark, "lexical-hits"), None
        for i in range(blocks):
            block = _block(questions.where(place == i).toArrow())
            shared = spark.sparkContext.broadcast(block)
            postings = written(plain.mapInArrow(_postings(shared), _POSTINGS), "postings")
            if sizes is None:
                sizes = postings.agg(F.count("*"), F.sum("n")).first()
            df = np.zeros(len(block.terms), np.int64)
            for row in postings.select("terms").mapInArrow(_frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
                df[row[0]] = row[1]
            search = _searched(shared, df, sizes[0], sizes[1] or 0, k)
            hits = postings.mapInArrow(search, f"place int, item_id {kind}, doc_id long, score long")
            hits.withColumn("place", F.col("place") + F.lit(i).cast("long") * (1 << 32)).write.parquet(f"{out}/{i}")
            shared.destroy()
        found = spark.read.option("recursiveFileLookup", True).schema(f"place long, item_id {kind}, doc_id long, score long").parquet(out)
        return _ranked(found, k).select("item_id", "rank", "doc_id", "score")

    return settled(make, spark, "lexical-search")


#: The same rows in DuckDB.
ORACLE = rf"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT rid, doc_id, terms, len(terms) AS n FROM low WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sized),
asked AS (
  SELECT place, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS place, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tfs AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM sized)
  SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY 1), whole),
impacts AS (
  SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS gain
  FROM tfs JOIN sized USING (rid) JOIN weights USING (term), whole),
scored AS (
  SELECT place, item_id, rid, sum(times * gain)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scored JOIN sized USING (rid) WHERE score > 0 QUALIFY rank <= {K}
"""
