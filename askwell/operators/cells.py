"""Dense retrieval by a coarse quantiser: vectors lie in cells, and most cells need not be looked at.

Vectors are stored at unit length in the cell of their nearest centre, with their distance to it; the
centres come from k-means over a bounded sample. A question first looks at the cells nearest to it. What it
finds there bounds how far its k-th nearest can be; by the triangle inequality a vector is no nearer than
the difference of the question's and its own distance to their centre, so whole cells, and vectors within
a cell, that can't come closer are left out. What remains is looked at in a second step, so the hits are
exactly those of scoring every vector. How much is left out depends on the vectors: if they don't
cluster, little is.

Every cell is stored in shares of a bounded number of vectors, which meet their questions in tasks of their
own, so a cell that holds a third of all vectors is no hot key. Vectors that are null, zero or not finite are
not stored; vectors of a length that the sample doesn't have lie in a cell that is always looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askwell.operators.retrieve import DEFAULT_K, RANK_DIGITS, _unit_rows, rank_hits
from askwell.session import delete, scratch_path, written

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors that centres are fitted on, rounds of it, most centres, and vectors of a share of a cell.
SAMPLE, ROUNDS, MOST_CELLS, SHARE_ROWS = 20_000, 12, 1024, 50_000
OTHER = -1  # the cell without a centre
# Distances are rounded for ranking; bounds allow for that.
SLACK = 2 * 10.0**-RANK_DIGITS

_STORED = "cell int, share int, own double, chunk_id {id}, vector array<double>"


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over unit vectors; the first centres are spread over the sample's order."""
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(np.int64)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        counts = np.bincount(nearest, minlength=cells)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _usable(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: places of the usable vectors, and these at unit length."""
    for width, (places, rows) in _unit_rows(vectors).items():
        good = np.isfinite(rows).all(1)
        if good.any():
            yield width, places[good], rows[good]


class VectorCells:
    """Stored vectors by cell, below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def centres(self) -> dict[int, np.ndarray]:
        """By length of the vectors: at most ``MOST_CELLS`` centres each."""
        rows = self.spark.read.parquet(f"{self.root}/centres").orderBy("width", "cell").collect()
        widths = {r.width for r in rows}
        return {w: np.array([r.centre for r in rows if r.width == w]) for w in widths}

    def build(self, chunks: DataFrame, cells: int | None = None, chunk_id: str = "chunk_id", vector: str = "vector") -> None:
        """Fit centres on a sample of at most ``SAMPLE`` vectors and store all vectors by cell."""
        rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("vector")).where(F.size("vector") > 0)
        count = rows.count()
        sample = rows.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector").toArrow()
        fitted = []
        for width, _, unit in _usable(sample.column(0).combine_chunks()):
            n = min(cells or int(count**0.5) + 1, MOST_CELLS, len(unit))
            fitted += [(width, i, c.tolist()) for i, c in enumerate(fit_centres(unit, n))]
        self.spark.createDataFrame(fitted, "width int, cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.root}/centres")
        schema = _STORED.format(id=rows.schema["chunk_id"].dataType.simpleString())
        shared = self.spark.sparkContext.broadcast(self.centres())
        path = scratch_path(self.spark, "cells")
        try:
            placed = written(rows.withColumn("share", F.lit(0)).mapInArrow(_assign(shared), schema), path)
            shared.destroy()
            placed.limit(0).write.mode("overwrite").parquet(f"{self.root}/schema")
            sizes = placed.groupBy("cell").agg(F.count("*").alias("vectors"), F.max("own").alias("radius"))
            sizes = sizes.withColumn("shares", F.ceil(F.col("vectors") / SHARE_ROWS).cast("int"))
            sizes.write.mode("overwrite").parquet(f"{self.root}/sizes")
            shares = self.sizes().select("cell", "shares")  # at most MOST_CELLS per length
            dealt = placed.join(F.broadcast(shares), "cell").withColumn("share", F.pmod(F.xxhash64("chunk_id"), "shares").cast("int"))
            dealt.drop("shares").repartition("cell", "share").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")
        finally:
            delete(self.spark, path)

    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/sizes")

    def search(self, questions: DataFrame, k: int = DEFAULT_K, query_id: str = "query_id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
        """The ``k`` nearest per question (``query_id, chunk_id, distance, rank``), and what was looked at.

        The second frame has ``query_id``, ``scored`` (vectors compared) and ``stored`` (all vectors). Questions
        are answered here and now, in two steps, into tables in the scratch folder.
        """
        spark = self.spark
        asked = questions.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).where(F.size("vector") > 0)
        sizes = {r.cell: (r.vectors, r.radius, r.shares) for r in self.sizes().collect()}
        shared = spark.sparkContext.broadcast((self.centres(), sizes))
        stored = spark.read.schema(spark.read.parquet(f"{self.root}/schema").schema).parquet(f"{self.root}/vectors")
        kind, found = asked.schema["query_id"].dataType, stored.schema["chunk_id"].dataType
        visit = T.StructType(
            [
                T.StructField("query_id", kind),
                T.StructField("asked", T.ArrayType(T.DoubleType())),
                T.StructField("limit", T.DoubleType()),
                T.StructField("far", T.DoubleType()),
                T.StructField("cell", T.IntegerType()),
                T.StructField("share", T.IntegerType()),
            ]
        )
        hit = T.StructType(
            [
                T.StructField("query_id", kind),
                T.StructField("chunk_id", found),
                T.StructField("distance", T.DoubleType()),
                T.StructField("scored", T.LongType()),
            ]
        )

        def look(visits: DataFrame, name: str) -> DataFrame:
            met = visits.groupBy("cell", "share").cogroup(stored.groupBy("cell", "share"))
            return written(met.applyInArrow(_compare(k), hit), scratch_path(spark, name))

        start = asked.withColumn("limit", F.lit(None).cast("double"))
        first = look(start.mapInArrow(_visits(shared, k), visit), "near-cells")
        ranked = rank_hits(first.where("chunk_id IS NOT NULL").select("query_id", "chunk_id", "distance"), k)
        kth = ranked.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
        # A question with fewer hits than k looks at everything.
        limit = F.coalesce(F.sqrt(2 * (F.col("kth") + SLACK)), F.lit(4.0))
        rest = asked.join(kth, "query_id", "left").select("query_id", "vector", limit.alias("limit"))
        second = look(rest.mapInArrow(_visits(shared, k), visit), "far-cells")
        both = first.unionByName(second)
        hits = rank_hits(both.where("chunk_id IS NOT NULL").select("query_id", "chunk_id", "distance"), k)
        looked = both.groupBy("query_id").agg(F.sum("scored").alias("scored"))
        return hits, looked.withColumn("stored", F.lit(sum(n for n, *_ in sizes.values())).cast("long"))


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, places, rows in _usable(batch.column("vector")):
                centres = shared.value.get(width)
                if centres is None:
                    cell, own = np.full(len(rows), OTHER), np.zeros(len(rows))
                else:
                    far = _distances(rows, centres)
                    cell, own = far.argmin(1), far.min(1)
                    cell = cell + 10_000 * width
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
                columns = [cell.astype(np.int32), np.zeros(len(rows), np.int32), own]
                ids = batch.column("chunk_id").take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, lists], names=["cell", "share", "own", "chunk_id", "vector"])

    return assign


def _nearest_cells(far: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The nearest cells that hold twice ``k`` vectors together."""
    order = np.argsort(far, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(vectors[order]), 2 * k)) + 1]


def _visits(shared, k: int):
    """The shares that a question looks at: of the nearest cells if it has no limit, else of the others within it."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes = shared.value
        for batch in batches:
            limits = batch.column("limit").to_pylist()
            rows: list[tuple] = []
            for width, places, unit in _usable(batch.column("vector")):
                cells = [c for c in sizes if c // 10_000 == width and c >= 0]
                far = _distances(unit, centres[width][[c % 10_000 for c in cells]]) if cells else np.zeros((len(unit), 0))
                vectors, radius = (np.array([sizes[c][i] for c in cells]) for i in (0, 1))
                for place, vector, to in zip(places.tolist(), unit, far):
                    near = _nearest_cells(to, vectors, k) if len(to) else np.zeros(0, np.int64)
                    limit = limits[place]
                    wanted = near if limit is None else np.setdiff1d(np.flatnonzero(to - radius <= limit), near)
                    own = [(cells[i], float(to[i])) for i in wanted]
                    if limit is not None and OTHER in sizes:
                        own.append((OTHER, 0.0))
                    rows += [(place, vector, limit if limit is not None else 4.0, to_, c, s) for c, to_ in own for s in range(sizes[c][2])]
            if rows:
                place, vector, limit, to, cell, share = zip(*rows)
                lists = pa.array(list(vector), pa.list_(pa.float64()))
                ids = batch.column("query_id").take(pa.array(place))
                numbers = (pa.array(limit, pa.float64()), pa.array(to, pa.float64()), pa.array(cell, pa.int32()), pa.array(share, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, lists, *numbers], names=["query_id", "asked", "limit", "far", "cell", "share"])

    return visits


def _compare(k: int):
    def compare(visits: pa.Table, stored: pa.Table) -> pa.Table:
        ids = stored.column("chunk_id").combine_chunks() if len(stored) else None
        by_id = stored.column("chunk_id").to_numpy(zero_copy_only=False) if len(stored) else None
        own = stored.column("own").to_numpy() if len(stored) else np.zeros(0)
        parts = dict((w, (p, r)) for w, p, r in _usable(stored.column("vector").combine_chunks())) if len(stored) else {}
        out: list[tuple] = []
        far, limit = visits.column("far").to_numpy(), visits.column("limit").to_numpy()
        for q, vector in enumerate(visits.column("asked")):
            vector = np.array(vector.as_py())
            places, rows = parts.get(len(vector), (np.zeros(0, np.int64), np.zeros((0, len(vector)))))
            near = np.abs(far[q] - own[places]) <= limit[q] + SLACK if len(places) and stored.column("cell")[0].as_py() != OTHER else np.ones(len(places), bool)
            places, rows = places[near], rows[near]
            distance = np.round(1.0 - rows @ vector, RANK_DIGITS)
            if len(distance) > k:
                top = distance <= np.partition(distance, k - 1)[k - 1]
                places, distance = places[top], distance[top]
            order = np.lexsort((by_id[places], distance))[:k] if len(places) else []
            out += [(q, int(places[i]), float(distance[i]), 0) for i in order]
            out.append((q, None, None, len(rows)))
        q, at, distance, scored = zip(*out) if out else ((),) * 4
        taken = ids.take(pa.array(at, pa.int64())) if ids is not None else pa.nulls(len(at), stored.schema.field("chunk_id").type)
        names = visits.column("query_id").combine_chunks().take(pa.array(q, pa.int64()))
        return pa.table({"query_id": names, "chunk_id": taken, "distance": pa.array(distance, pa.float64()), "scored": pa.array(scored, pa.int64())})

    return compare
