"""A stored inverted index for sparse retrieval: the terms asked for are read, not the corpus.

Chunks are dealt to shards of a bounded number of postings and numbered within them in the order of
their ids. A list holds the chunks of one term in one shard, with counts and squared lengths, and the
most that the term can add to a cosine there. So the lists of a frequent term are spread over all
shards, and no list grows with the corpus. Lists lie in folders by a hash of their term.

A question is answered from the lists of its own terms: an equi-join on the term brings them, each shard's
lists meet in one task, and the task answers all questions over them, the shortest list first. A chunk gets a
score at its first term, until what the other terms can add at most is below the k-th best score so far;
from there on only chunks that have a score are looked at. So the k best are exact, as if every chunk had
been scored.

A chunk's id stands for its text, so its postings never change: an addition brings only ids that the index
doesn't hold, as shards of its own, and one that is run again brings nothing.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askwell.operators.retrieve import DEFAULT_K, LANES, RANK_DIGITS
from askwell.session import delete, scratch_path, written

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Postings of a shard, the unit of parallel work, and folders that lists are dealt to by their term.
SHARD_POSTINGS = 1_000_000
PARTS = 256
# Copies of the asked terms that a frequent term's lists are shared out to.
SALTS = 16
# Asked terms, all questions together, that meet one shard's lists in a task.
SLICE_TERMS = 500_000


_LISTS = "term string, shard long, docs array<int>, tfs array<int>, squares array<long>, most double"


def _squares(vector: str) -> Column:
    return F.expr(f"aggregate({vector}, 0L, (sum, t) -> sum + t.tf * t.tf)")


class PostingsIndex:
    """The index below ``root``; ``parts`` must stay as it is once there is an addition."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, shard_postings: int = SHARD_POSTINGS):
        self.spark, self.root, self.parts, self.shard_postings = spark, root.rstrip("/"), parts, shard_postings

    def additions(self) -> list[int]:
        """Numbers of the complete additions; their list of chunks is written last."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/chunks/added=*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("added=")) for f in found)

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = [f"{self.root}/{name}/added={a}" for a in self.additions()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*folders)

    def chunks(self) -> DataFrame:
        """``chunk_id``, its place (``shard``, ``doc``) and the embedder of its vector."""
        return self._read("chunks", "shard long, doc int, chunk_id string, embedder string")

    def lists(self) -> DataFrame:
        """``term, shard, docs, tfs, squares, most`` and the folder ``part``."""
        return self._read("lists", f"{_LISTS}, part int")

    def _part(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def add(self, chunks: DataFrame) -> bool:
        """Take in the chunks (``chunk_id``, term ``vector``, ``embedder``) whose ids the index doesn't hold."""
        done = self.additions()
        new = chunks.select("chunk_id", "vector", "embedder")
        if done:
            new = new.join(self.chunks().select("chunk_id"), "chunk_id", "left_anti")
        path = scratch_path(self.spark, "vectors")
        try:
            # A condition on vectors that aren't written yet would have them made twice.
            new = written(new, path).where(F.size("vector") > 0)
            postings = new.agg(F.sum(F.size("vector"))).first()[0]
            if not postings:
                return False
            number = max(done, default=-1) + 1
            shard = F.pmod(F.xxhash64("chunk_id"), F.lit(-(-postings // self.shard_postings))) + F.lit(number).cast("long") * (1 << 32)
            placed = new.withColumn("shard", shard)
            lists = placed.select("shard", "chunk_id", "vector").groupBy("shard").applyInArrow(_lists_of_shard, _LISTS)
            # A folder with more than a task's share of postings is written by several tasks.
            dealt = lists.withColumn("part", self._part("term")).hint("rebalance", "part").sortWithinPartitions("part", "term")
            dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/lists/added={number}")
            inside = Window.partitionBy("shard").orderBy("chunk_id")
            ids = placed.select("shard", (F.row_number().over(inside) - 1).alias("doc"), "chunk_id", "embedder")
            ids.write.mode("overwrite").parquet(f"{self.root}/chunks/added={number}")
            return True
        finally:
            delete(self.spark, path)

    def search(self, questions: DataFrame, k: int = DEFAULT_K) -> DataFrame:
        """The ``k`` nearest chunks per question: ``query_id, chunk_id, distance, rank``.

        ``questions``: ``query_id`` and a term ``vector``. Exact; equal distances are ordered by chunk id.
        The driver learns which folders are asked for (at most ``parts``) and how many terms there are.
        """
        asked = questions.select("query_id", _squares("vector").alias("squares"), F.explode("vector").alias("t"))
        asked = asked.select(F.struct("query_id", "t.tf", "squares").alias("by"), "t.term", self._part("t.term").alias("part"))
        wanted = {r.part: r.n for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
        slices = -(-sum(wanted.values()) // SLICE_TERMS) or 1
        by_term = asked.withColumn("slice", F.pmod(F.xxhash64("by.query_id"), F.lit(slices)).cast("int"))
        by_term = by_term.groupBy("term", "slice").agg(F.collect_list("by").alias("by"))
        salted = by_term.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = self.lists().where(F.col("part").isin(sorted(wanted))).drop("part")
        lists = lists.withColumn("salt", F.pmod("shard", F.lit(SALTS)).cast("int"))
        query_id = questions.schema["query_id"]
        hit = T.StructType(
            [
                T.StructField("query_id", query_id.dataType),
                T.StructField("shard", T.LongType()),
                T.StructField("doc", T.IntegerType()),
                T.StructField("distance", T.DoubleType()),
            ]
        )
        met = lists.join(salted, ["term", "salt"]).drop("salt", "term")
        hits = met.groupBy("shard", "slice").applyInArrow(_best_of_shard(k), hit)
        # Ties stay in until ids are known: at most k of a shard.
        lane = Window.partitionBy("query_id", "lane").orderBy("distance")
        few = hits.withColumn("lane", F.pmod("shard", F.lit(LANES))).withColumn("rank", F.rank().over(lane)).where(F.col("rank") <= k)
        few = few.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy("distance"))).where(F.col("rank") <= k)
        named = few.drop("rank", "lane").join(self.chunks(), ["shard", "doc"])
        near = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        return named.select("query_id", "chunk_id", "distance", F.row_number().over(near).alias("rank")).where(F.col("rank") <= k)


def _lists_of_shard(table: pa.Table) -> pa.Table:
    """The lists of one shard's chunks, which are numbered by their ids."""
    table = table.sort_by("chunk_id")
    vectors = table.column("vector").combine_chunks()
    doc = np.repeat(np.arange(len(table)), vectors.value_lengths().to_numpy(zero_copy_only=False))
    cells = vectors.flatten()
    tf = cells.field("tf").to_numpy(zero_copy_only=False).astype(np.int64)
    squares = np.bincount(doc, tf * tf, len(table)).astype(np.int64)[doc]
    terms = cells.field("term").dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")  # by term, then by chunk
    doc, tf, squares = doc[order], tf[order], squares[order]
    begin = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
    in_lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.astype(kind)))
    return pa.table(
        {
            "term": terms.dictionary,
            "shard": pa.array(np.full(len(terms.dictionary), table.column("shard")[0].as_py(), np.int64)),
            "docs": in_lists(doc, np.int32),
            "tfs": in_lists(tf, np.int32),
            "squares": in_lists(squares, np.int64),
            "most": np.maximum.reduceat(tf / np.sqrt(squares), begin[:-1]),
        }
    )


class ShardLists:
    """The lists of one shard, ready to be searched."""

    def __init__(self, docs: list[np.ndarray], tfs: list[np.ndarray], squares: list[np.ndarray], most: np.ndarray):
        self.docs, self.tfs, self.most = docs, tfs, most
        self.size = 1 + max(int(d[-1]) for d in docs)
        self.squares = np.ones(self.size)
        for at, value in zip(docs, squares):
            self.squares[at] = value
        self.length = np.sqrt(self.squares)

    def best(self, asked: list[tuple[int, int]], squares: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances and chunks of the best ``k``, nearest first, and how many chunks got a score.

        ``asked``: (list, count in the question); ``squares``: the question's squared length.
        """
        asked = sorted(asked, key=lambda lt: (len(self.docs[lt[0]]), lt[0]))
        left = np.cumsum([tf * self.most[at] for at, tf in reversed(asked)])[::-1]
        # Distances are compared at RANK_DIGITS digits; what differs by less must not be left out.
        slack = 2 * 10.0**-RANK_DIGITS * squares**0.5
        dots, held, open_ = np.zeros(self.size), np.zeros(self.size, bool), True
        top = 0.0
        for (at, tf), rest in zip(asked, left):
            rows, gain = self.docs[at], tf * self.tfs[at]
            if open_ and top > rest:  # the k-th best score can't be more than the best
                partial = (dots / self.length)[held]
                open_ = len(partial) < k or np.partition(partial, -k)[-k] <= rest + slack
            if not open_:
                known = held[rows]
                rows, gain = rows[known], gain[known]
            dots[rows] += gain
            held[rows] = True
            top = max(top, float((dots[rows] / self.length[rows]).max(initial=0.0)))
        found = np.flatnonzero(held)
        distance = np.round(1.0 - dots[found] / np.sqrt(squares * self.squares[found]), RANK_DIGITS)
        if len(found) > k:
            near = distance <= np.partition(distance, k - 1)[k - 1]
            found, distance = found[near], distance[near]
        order = np.lexsort((found, distance))[:k]
        return distance[order], found[order], int(held.sum())


def _best_of_shard(k: int):
    def search(table: pa.Table) -> pa.Table:
        arrays = {c: table.column(c).combine_chunks() for c in ("docs", "tfs", "squares", "by")}

        def cut(name: str) -> list[np.ndarray]:
            flat = arrays[name].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(arrays[name].value_lengths().to_numpy(zero_copy_only=False))
            return np.split(flat, ends[:-1])

        lists = ShardLists(cut("docs"), cut("tfs"), cut("squares"), table.column("most").to_numpy())
        by = arrays["by"].flatten()
        ids = by.field("query_id").dictionary_encode()
        number, tf = ids.indices.to_numpy(zero_copy_only=False), by.field("tf").to_pylist()
        squares = by.field("squares").to_pylist()
        owner = np.repeat(np.arange(len(table)), arrays["by"].value_lengths().to_numpy(zero_copy_only=False))
        asked, lengths = defaultdict(list), {}
        for q, at, count, length in zip(number.tolist(), owner.tolist(), tf, squares):
            asked[q].append((at, count))
            lengths[q] = length
        rows = [(q, *lists.best(own, lengths[q], k)[:2]) for q, own in asked.items()]
        query = np.repeat([q for q, *_ in rows], [len(d) for _, d, _ in rows]).astype(np.int64)
        return pa.table(
            {
                "query_id": ids.dictionary.take(pa.array(query)),
                "shard": pa.array([table.column("shard")[0].as_py()] * len(query), pa.int64()),
                "doc": pa.array(np.concatenate([f for *_, f in rows]).astype(np.int32)),
                "distance": pa.array(np.concatenate([d for _, d, _ in rows])),
            }
        )

    return search
