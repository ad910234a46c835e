"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by several functions ``floor((a . v + b) / width)`` with normal ``a``; the
tuple is its bucket. A query visits the buckets around its own in the order in which they are
likely to hold a neighbour: a neighbour at distance R moves each projection by a normal step of
deviation R, which gives each function's shifts a probability, and a bucket the product of them. It
visits buckets until their probabilities add up to what each table must contribute for the target
recall over all tables. R is measured on a bounded sample (``SAMPLE`` vectors): the distance within
which ``REACH`` of them have their nearest. The number of functions grows with the logarithm of the
rows, so that buckets stay small.

Candidates of all tables are scored by exact distance inside the tasks; only the best of each query
and task leave it. A query that would have to visit more than ``MOST`` buckets of a table is compared with
all vectors instead, block by block. Equal vectors are one candidate that carries its smallest ids, as
no more of them can be among the nearest. Buckets of many distinct vectors are dealt over several tasks.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take
no part, nor do rows without an id; vectors of other lengths never meet; fewer candidates than ``k``
give fewer rows; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import documents, settled, written

K = 10
TABLES = 8
WIDTH = 2.0  # of a bucket, in units of R
RECALL = 0.97  # estimated, over all tables
SAMPLE = 2_000
REACH = 0.95
#: Distinct vectors of a bucket in one task, and about the rows of a task.
SPLIT = 20_000
#: Buckets that a query visits in one table; beyond them it meets all vectors.
MOST = 100_000
SEED = 77


def functions_for(rows: int) -> int:
    return max(3, round(math.log2(max(rows, 2)) / 1.7))


def projections(vectors: np.ndarray, table: int, functions: int, width: float) -> np.ndarray:
    rng = np.random.default_rng([SEED, table, vectors.shape[1]])
    a = rng.normal(size=(vectors.shape[1], functions))
    return (vectors @ a + rng.uniform(0, width, functions)) / width


def keys_of(buckets: np.ndarray, table: int, size: int) -> np.ndarray:
    key = np.full(len(buckets), np.uint64(table * 1_000_003 + size), np.uint64)
    for column in buckets.astype(np.int64).T:
        key = (key ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _below(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def visited(position: np.ndarray, spread: float, enough: float, most: int | None = None) -> np.ndarray | None:
    """Buckets around ``position`` (in bucket widths) in falling probability, until ``enough`` is covered.

    ``spread``: deviation of a neighbour's projection, in bucket widths. None if more than ``most`` are needed.
    """
    most = most or MOST
    own = np.floor(position)
    choices = []
    for x, b in zip(position, own):
        near = []
        for shift in range(-6, 7):
            low, high = b + shift - x, b + shift + 1 - x
            p = _below(high / spread) - _below(low / spread)
            if p > 1e-9:
                near.append((-math.log(p), shift))
        choices.append(sorted(near))
    # Best first over the ranks chosen for each function; a state is reached once, from the state
    # with its last raised rank lowered.
    start = sum(c[0][0] for c in choices)
    heap = [(start, (0,) * len(choices), 0)]
    out, covered = [], 0.0
    while heap and covered < enough:
        if len(out) == most:
            return None
        cost, ranks, last = heapq.heappop(heap)
        covered += math.exp(-cost)
        out.append([b + choices[i][r][1] for i, (b, r) in enumerate(zip(own, ranks))])
        for i in range(last, len(choices)):
            r = ranks[i]
            if r + 1 < len(choices[i]):
                step = choices[i][r + 1][0] - choices[i][r][0]
                heapq.heappush(heap, (cost + step, ranks[:i] + (r + 1,) + ranks[i + 1 :], i))
    return np.array(out)


def nearest_in(vectors: np.ndarray, reps: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows and their exact distances, ties to the smaller representative."""
    rough = (vectors * vectors).sum(1) - 2 * (vectors @ query)
    if len(rough) > 4 * k:
        edge = np.partition(rough, k - 1)[k - 1]
        rows = np.flatnonzero(rough <= edge + 1e-9 * (1 + abs(edge) + float(query @ query)))
    else:
        rows = np.arange(len(rough))
    score = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
    order = np.lexsort((reps[rows], score))[:k]
    return rows[order], score[order]


def _stacked(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    sizes = column.map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.stack([column.iloc[i] for i in rows])


def _hasher(functions: int, width: float, tables: int):
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, matrix in _stacked(frame["vec"]) if len(frame) else ():
                for t in range(tables):
                    keys = keys_of(np.floor(projections(matrix, t, functions, width)), t, matrix.shape[1])
                    yield pd.DataFrame({"bucket": keys, "rep": frame["rep"].to_numpy()[rows], "vec": frame["vec"].iloc[rows].to_numpy()})

    return hashed


def _prober(functions: int, width: float, tables: int, spread: float, enough: float, most: int):
    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, matrix in _stacked(frame["vec"]) if len(frame) else ():
                for t in range(tables):
                    for i, position in zip(rows, projections(matrix, t, functions, width)):
                        buckets = visited(position, spread, enough, most)
                        keys = np.zeros(1, np.int64) if buckets is None else keys_of(buckets, t, matrix.shape[1])
                        yield pd.DataFrame({"bucket": keys, "q": frame["rep"].iloc[i], "all": buckets is None})

    return probes


def _scored(k: int):
    def score(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(probes):
            index = index.sort_values("part", kind="stable")
            parts, reps = index["part"].to_numpy(), index["rep"].to_numpy()
            for rows, matrix in _stacked(index["vec"]):
                own = parts[rows]
                for q, vec, wanted in zip(probes["q"], probes["vec"], probes["parts"]):
                    if len(vec) != matrix.shape[1]:
                        continue
                    low, high = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
                    sizes = high - low
                    if not sizes.sum():
                        continue
                    at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    best, score = nearest_in(matrix[at], reps[rows][at], np.asarray(vec), k)
                    out.append(pd.DataFrame({"q": q, "rep": reps[rows][at][best], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []}).astype({"q": "int64", "rep": "int64", "score": "float64"})

    return score


def _radius(vectors: DataFrame, rows: int, k: int) -> float:
    """Distance within which most vectors have their ``k`` nearest, from a sample.

    In a sample of n vectors, the neighbour of rank ``k * n / rows`` is as far as the k-th among all rows; the
    first stands in for lower ranks, which errs to the far side. Vectors differ, so the ``REACH``
    quantile over them is taken.
    """
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"]
    found = []
    for _, m in _stacked(sample) if len(sample) else ():
        if len(m) < 2:
            continue
        square = (m * m).sum(1)
        d = square[:, None] + square - 2 * (m @ m.T)
        np.fill_diagonal(d, np.inf)
        rank = min(max(1, math.ceil(k * len(m) / max(rows, 1))), len(m) - 1)
        found.append(np.sqrt(np.maximum(np.partition(d, rank - 1, axis=1)[:, rank - 1], 0)))
    found = np.concatenate(found) if found else np.zeros(0)
    return float(np.quantile(found, REACH)) or 1.0 if len(found) else 1.0


def nearest_neighbours(frame: DataFrame, is_query, k: int = K, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds."""
    return settled(lambda: _nearest_neighbours(frame, is_query, k, tables, recall), frame.sparkSession, "neighbours")


def _nearest_neighbours(frame: DataFrame, is_query, k: int, tables: int, recall: float) -> DataFrame:
    spark = frame.sparkSession
    plain = documents(frame, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.expr("transform(embedding, x -> cast(x as double))").alias("vec"))
    fine = "id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vec, x -> x <> 0)"
    valid = plain.where(fine)
    first = valid.withColumn("n", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    vectors = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = written(vectors.select(F.col("ids")[0].alias("rep"), "vec", "ids"), "vectors")
    asked = valid.where(is_query(F.col("id"))).join(vectors.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    asked = written(asked, "asked")
    rows = vectors.count()
    functions, radius = functions_for(rows), _radius(vectors, rows, k)
    width = WIDTH * radius
    enough = 1 - (1 - recall) ** (1 / tables)
    index = vectors.mapInPandas(_hasher(functions, width, tables), "bucket long, rep long, vec array<double>")
    asking = vectors.join(asked.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi").select("rep", "vec")
    lanes = max(spark.sparkContext.defaultParallelism, 1)
    prober = _prober(functions, width, tables, 1 / WIDTH, enough, MOST)
    probes = written(asking.repartition(lanes).mapInPandas(prober, "bucket long, q long, all boolean"), "probes")
    probes, whole = probes.where("NOT all").drop("all"), probes.where("all").select("q").distinct()
    # Buckets of many distinct vectors fall apart into parts; a query visits them all.
    large = vectors.mapInPandas(_bucket_counter(functions, width, tables), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = written(large.where(F.col("n") > SPLIT).select(F.col("bucket").alias("large"), F.ceil(F.col("n") / SPLIT).alias("parts")), "large")
    blocks = max(1, math.ceil(rows / SPLIT)) * tables
    split = lambda d: d.join(large, F.col("bucket") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    index = split(index).withColumn("part", F.xxhash64("bucket", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    probes = split(probes).withColumn("part", F.explode(F.expr("transform(sequence(0L, parts - 1), p -> xxhash64(bucket, p))")))
    block = F.pmod(F.col("part"), F.lit(blocks))
    index = index.select(block.alias("block"), "part", "rep", "vec")
    probes = probes.groupBy(block.alias("block"), "q").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    probes = probes.join(vectors.select(F.col("rep").alias("q"), "vec"), "q")
    found = index.groupBy("block").cogroup(probes.groupBy("block")).applyInPandas(_scored(k + 1), "q long, rep long, score double")
    # Queries that meet all vectors: one block of vectors after another.
    own = max(1, math.ceil(rows / SPLIT))
    every = vectors.select(F.pmod(F.xxhash64("rep"), F.lit(own)).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), "rep", "vec")
    whole = whole.join(vectors.select(F.col("rep").alias("q"), F.col("vec").alias("vec")), "q").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(own - 1).cast("long"))))
    whole = whole.select("block", "q", F.array(F.lit(0).cast("long")).alias("parts"), "vec")
    found = found.unionByName(every.groupBy("block").cogroup(whole.groupBy("block")).applyInPandas(_scored(k + 1), "q long, rep long, score double"))
    best = found.groupBy("q", "rep").agg(F.min("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("score", "rep"))).where(F.col("n") <= k + 1)
    best = best.join(vectors.select("rep", "ids"), "rep").select("q", "score", "ids")
    pairs = asked.join(best, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bucket_counter(functions: int, width: float, tables: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, matrix in _stacked(frame["vec"]) if len(frame) else ():
                for t in range(tables):
                    keys = keys_of(np.floor(projections(matrix, t, functions, width)), t, matrix.shape[1])
                    bucket, n = np.unique(keys, return_counts=True)
                    yield pd.DataFrame({"bucket": bucket, "n": n.astype(np.int64)})

    return count
