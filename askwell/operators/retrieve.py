"""Exact top-k retrieval by cosine distance.

Each task scores its own share of the chunks against a broadcast slice of the
questions and keeps a running top-k per question. What is shuffled is therefore
at most ``k`` rows per question and task, never a row per (question, chunk)
pair, and one pass over the chunks serves a whole slice of questions. Questions
beyond one slice are answered by further passes, so the broadcast stays bounded
however many there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askwell.session import scratch_path

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_K = 5
# Questions per broadcast slice; a question is cut to 1000 characters, so even
# with all of them distinct words a slice stays in the tens of megabytes.
SLICE_QUESTIONS = 10_000
SLICE_BYTES = 64 << 20
# Lanes in which a question's hits are ranked before they meet.
LANES = 64
# Score cells a task holds at a time.
CELLS = 4_000_000
# Score cells of one term from which they are filled by themselves.
WIDE_TERM = 1_000
# Distances are compared at this precision, equal ones by chunk id.
RANK_DIGITS = 9


class _TermScorer:
    """Cosine of (term, tf) vectors. Counts are whole, so sums are exact."""

    def __init__(self, vectors: pa.Array):
        flat, owner = _unnest(vectors)
        tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
        self.size = len(vectors)
        self.norm2 = np.bincount(owner, tf * tf, minlength=self.size)
        terms = flat.field("term").dictionary_encode()
        self.vocabulary = terms.dictionary
        code = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.asked, self.weight = owner[order], tf[order]
        self.many = np.bincount(code, minlength=len(self.vocabulary))
        self.begin = np.cumsum(self.many) - self.many

    def distances(self, vectors: pa.Array) -> np.ndarray:
        flat, owner = _unnest(vectors)
        tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
        norm2 = np.bincount(owner, tf * tf, minlength=len(vectors))
        code = pc.index_in(flat.field("term"), value_set=self.vocabulary)
        code = code.fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(code >= 0)
        order = known[np.argsort(code[known], kind="stable")]
        codes, begins, sizes = np.unique(code[order], return_index=True, return_counts=True)
        dots = np.zeros((self.size, len(vectors)))
        # A term of many cells fills them at once; those of the others are gathered and summed together.
        wide = sizes * self.many[codes] > WIDE_TERM
        for at, begin, size in zip(codes[wide], begins[wide], sizes[wide]):
            rows, own = order[begin : begin + size], slice(self.begin[at], self.begin[at] + self.many[at])
            dots[np.ix_(self.asked[own], owner[rows])] += np.outer(self.weight[own], tf[rows])
        rows = order[np.repeat(~wide, sizes)]
        many = self.many[code[rows]]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(many) // CELLS)) + 1):
            own, n = rows[part], many[part]
            pairs = np.repeat(self.begin[code[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cells = self.asked[pairs] * len(vectors) + np.repeat(owner[own], n)
            dots += np.bincount(cells, self.weight[pairs] * np.repeat(tf[own], n), dots.size).reshape(dots.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = 1.0 - dots / np.sqrt(np.outer(self.norm2, norm2))
        # Nothing in common is no hit at all.
        return np.where(dots > 0, distance, np.inf)


class _DenseScorer:
    """Cosine of float vectors; a chunk whose vector has another length than a question's is no hit."""

    def __init__(self, vectors: pa.Array):
        self.size = len(vectors)
        self.parts = _unit_rows(vectors)

    def distances(self, vectors: pa.Array) -> np.ndarray:
        out = np.full((self.size, len(vectors)), np.inf)
        stored = _unit_rows(vectors)
        for width in self.parts.keys() & stored.keys():
            asked, rows = self.parts[width], stored[width]
            distance = 1.0 - asked[1] @ rows[1].T
            out[np.ix_(asked[0], rows[0])] = np.where(np.isnan(distance), np.inf, distance)
        return out


def _unnest(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, and for each the number of its list."""
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), owner


def _unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length: the places of the vectors of that length, and these at unit length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == width)
        rows = flat[begin[places][:, None] + np.arange(width)]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[width] = places, rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return out


def _scorer(vectors: pa.Array) -> _TermScorer | _DenseScorer:
    return _TermScorer(vectors) if pa.types.is_struct(vectors.type.value_type) else _DenseScorer(vectors)


def _array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Best:
    """Running top-k per question, ordered by (distance, id)."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.distance = np.full((size, k), np.inf)
        self.ids = np.empty((size, k), dtype=object)

    def add(self, distance: np.ndarray, ids: np.ndarray) -> None:
        distance = np.round(distance, RANK_DIGITS)
        limit = self.distance[:, -1]
        nearest_new = distance.min(axis=1)
        # After the first batches few questions see anything nearer than they have.
        for q in np.flatnonzero((nearest_new <= limit) & np.isfinite(nearest_new)):
            row, held = distance[q], np.isfinite(self.distance[q])
            bound = limit[q]
            if len(row) > self.k:
                bound = min(bound, np.partition(row, self.k - 1)[self.k - 1])
            near = np.flatnonzero((row <= bound) & np.isfinite(row))
            found = list(zip(row[near], ids[near]))
            found += zip(self.distance[q][held], self.ids[q][held])
            for j, (d, name) in enumerate(sorted(found)[: self.k]):
                self.distance[q, j], self.ids[q, j] = d, name


def _slice_count(questions: DataFrame, vector: str) -> int:
    width = F.size(vector) * 24 + 64
    total = questions.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return max(-(-total["n"] // SLICE_QUESTIONS), -(-(total["bytes"] or 0) // SLICE_BYTES), 1)


def nearest(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "vector",
) -> DataFrame:
    """The ``k`` nearest chunks per question: ``query_id, chunk_id, distance, rank``.

    Exact. Equal distances are ordered by chunk id. With term vectors a chunk must
    share a term with the question. Questions are answered here and now, slice after
    slice, into a table in the scratch folder; the driver never holds more than one
    slice, and a slice's broadcast is given back when it is answered.
    """
    spark = chunks.sparkSession
    stored = chunks.select(F.col(chunk_id).alias("id"), F.col(vector).alias("vector"))
    asked = questions.where(F.col(vector).isNotNull()).select(query_id, vector)
    count, out = _slice_count(asked, vector), scratch_path(spark, "hits")
    place = F.pmod(F.xxhash64(query_id), F.lit(count))
    for i in range(count):
        hits, shared = slice_hits(stored, asked.where(place == i), k)
        hits.write.parquet(f"{out}/{i}")
        shared.destroy()
    return spark.read.schema(hits.schema).option("recursiveFileLookup", True).parquet(out)


def slice_hits(stored: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The ranked hits of one slice of questions, and its broadcast. ``stored``: id, vector; ``asked``: id, vector."""
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema[0].dataType),
            T.StructField("chunk_id", stored.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    shared = stored.sparkSession.sparkContext.broadcast(asked.toArrow())
    return rank_hits(stored.mapInArrow(_search(shared, k), schema), k), shared


def _search(asked, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = asked.value
        names = _array(table.column(0))
        scorer = _scorer(_array(table.column(1)))
        best = _Best(scorer.size, k)
        id_type = None
        step = max(CELLS // max(scorer.size, 1), 1)
        for whole in batches:
            id_type = whole.schema.field("id").type
            usable = whole.filter(pc.is_valid(whole.column("vector")))
            for at in range(0, len(usable), step):
                batch = usable.slice(at, step)
                ids = np.array(batch.column("id").to_pylist(), dtype=object)
                best.add(scorer.distances(batch.column("vector")), ids)
        if id_type is None or not best.distance.size:
            return
        q, j = np.nonzero(np.isfinite(best.distance))
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(q)),
                pa.array(list(best.ids[q, j]), type=id_type),
                pa.array(best.distance[q, j]),
            ],
            names=["query_id", "chunk_id", "distance"],
        )

    return search


def rank_hits(hits: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Number the hits of each question by (distance, chunk id) and keep ``k``."""
    near = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    # Two stages: tasks of one lane first, so that no window holds the hits of all tasks.
    lane = Window.partitionBy("query_id", "_lane").orderBy("distance", "chunk_id")
    dealt = hits.withColumn("_lane", F.pmod(F.xxhash64("chunk_id"), F.lit(LANES)))
    few = dealt.withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= k).drop("_lane", "rank")
    return few.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def with_chunks(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Look the hits' text and metadata up; hits are a written table, whose size the optimizer knows."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")
