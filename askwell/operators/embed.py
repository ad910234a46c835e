"""The embedding stage: text to vectors, the one place a user plugs code in.

An embedder maps a DataFrame with a text column to the same rows with a
``vector`` column. Two shapes of vector are understood by retrieval: a list of
``(term, tf)`` with whole-number counts, and a list of floats.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.functions.text import quoted

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN_SEPARATORS = " \n\t.,;:!?|"
TERM_VECTOR = T.ArrayType(
    T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
)
DENSE_VECTOR = T.ArrayType(T.FloatType())


@dataclass(frozen=True)
class Embedder:
    """``name`` is stored with the vectors and compared when they are read."""

    name: str
    embed: Callable[[DataFrame, str], DataFrame]

    def __call__(self, df: DataFrame, text: str = "content") -> DataFrame:
        return self.embed(df, text).withColumn("embedder", F.lit(self.name))


# Which bytes belong to words; the separators are ASCII, so this holds inside UTF-8 too.
_IN_WORD = np.array([chr(b) not in TOKEN_SEPARATORS for b in range(256)])


def _counted(texts: pa.Array) -> pa.Array:
    """Sorted ``(term, tf)`` of each lower-cased text; a text that is null or has no word gets none."""
    n, texts = len(texts), texts.fill_null("")
    _, places, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _IN_WORD[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]  # words don't cross texts
    begins[at[:-1][full]] = inside[at[:-1][full]]
    stops[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - starts)])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(raw[inside].tobytes())]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # A text and a term make a number; sorted, equal ones form runs.
    owner = np.searchsorted(at, starts, "right") - 1
    cells = np.sort(owner * len(order) + rank[words.indices.to_numpy()])
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    owner, term = np.divmod(cells[first], max(len(order), 1))
    terms = words.dictionary.take(order).take(pa.array(term)).cast(pa.string())
    tf = pa.array(np.diff(np.append(first, len(cells))).astype(np.int32))
    sizes = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))


@F.arrow_udf(TERM_VECTOR)
def _term_counts(texts: pa.Array) -> pa.Array:
    return _counted(texts)


def term_counts(column: str) -> Column:
    """Bag of words of a row as sorted ``(term, tf)``, counted without a shuffle, an Arrow batch at a time."""
    return _term_counts(F.lower(F.col(quoted(column))))


def bag_of_words() -> Embedder:
    """Lexical default: no model is needed, and none is shipped."""

    def embed(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("vector", term_counts(text))

    return Embedder("bag-of-words", embed)


def word_bucket(word: str, dim: int) -> int:
    """A word's place in a hashed vector: the first 32 bits of its md5, as SQL has them too."""
    return int.from_bytes(md5(word.encode()).digest()[:4], "big") % dim


def _hashed_counts(terms: pa.Array, dim: int) -> pa.Array:
    """Vectors of unit length from ``(term, tf)`` lists."""
    counts = np.zeros((len(terms), dim))
    cells = terms.flatten()
    words = cells.field("term").dictionary_encode()
    place = np.fromiter((word_bucket(w, dim) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
    owner = np.repeat(np.arange(len(terms)), pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False))
    np.add.at(counts, (owner, place[words.indices.to_numpy(zero_copy_only=False)]), cells.field("tf").to_numpy(zero_copy_only=False))
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    unit = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))


def hashed_words(dim: int = 256) -> Embedder:
    """Fixed-width vectors of unit length from hashed term counts."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            own = _hashed_counts(batch.column(batch.num_columns - 1), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], names=[*names, "vector"])

    def embed(df: DataFrame, text: str) -> DataFrame:
        kept = df.drop("vector")
        schema = T.StructType([*kept.schema, T.StructField("vector", DENSE_VECTOR)])
        return kept.withColumn("_terms", term_counts(text)).mapInArrow(vectors, schema)

    return Embedder(f"hashed-words-{dim}", embed)


def batch_model(name: str, load: Callable[[], Callable[[pd.Series], list]], batch_size: int = 256) -> Embedder:
    """A user's model: ``load`` runs once per Python worker, its result once per at most ``batch_size`` texts."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()
        return lambda texts: np.array(list(model(pd.Series(texts, dtype=object))), np.float32)

    def embed(df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf

        vectors = predict_batch_udf(make, return_type=DENSE_VECTOR, batch_size=batch_size)
        return df.withColumn("vector", vectors(F.col(text)))

    return Embedder(name, embed)


def embedded_schema(store: T.StructType, vector: T.DataType) -> T.StructType:
    """The columns of a chunk table that keeps its vectors."""
    return T.StructType([*store, T.StructField("vector", vector), T.StructField("embedder", T.StringType())])


def check_same_embedder(stored: DataFrame, embedder: Embedder) -> None:
    """Vectors of different embedders must not be compared."""
    other = stored.where(~F.col("embedder").eqNullSafe(embedder.name)).select("embedder").head(1)
    if other:
        raise ValueError(f"store was embedded with {other[0][0]!r}, not {embedder.name!r}")
