"""Shared pieces of the training-data operators: bounded Arrow batches, words and hashes in numpy.

Tasks work on the UTF-8 bytes of a batch of texts at once. A word is a run of bytes other than
space and tab..carriage return, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at once (one longer text is worked on alone).
BATCH_BYTES = 2 << 20

_SOLID = bytes(b not in (0x20, *range(0x09, 0x0E)) for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bounded_batches(spark: SparkSession) -> None:
    """Limit what a Python worker gets at once, so that long texts don't fill its memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(frame: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; a column that is missing is null, others never clash with ours."""
    have = set(frame.columns)
    return frame.select(*(F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns))


_owned: ContextVar[list[str] | None] = ContextVar("scratch tables of the running operator", default=None)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared scratch folder: cuts the lineage, survives lost executors."""
    path = scratch_path(frame.sparkSession, name)
    if (owned := _owned.get()) is not None:
        owned.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The result of ``make`` as a scratch table; all tables that were written on the way are deleted."""
    path, token = scratch_path(spark, name), _owned.set([])
    try:
        frame = make()
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)
    finally:
        discard(spark)
        _owned.reset(token)


def discard(spark: SparkSession, *names: str) -> None:
    """Delete the running operator's scratch tables of these names, or all; without ``settled`` they stay."""
    for own in list(_owned.get() or ()):
        place = spark._jvm.org.apache.hadoop.fs.Path(own)
        if not names or place.getName().rpartition("-")[0] in names:
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _owned.get().remove(own)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one entry more than texts); null counts as empty."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if places is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the non-empty ranges of ``data``, eight bytes at a step."""
    n = len(starts)
    out = (ends - starts).astype(np.uint64) * _BASE
    if not n:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    long = np.flatnonzero(ends - starts > 1024)
    for i in long.tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    at, rows = starts, np.arange(n)
    if len(long):
        rows = np.flatnonzero(ends - starts <= 1024)
        at = starts[rows]
    left = ends[rows] - at
    while len(rows):
        value = eights[at]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[rows] = mixed(out[rows] * _M1 + value)
        on = np.flatnonzero(left > 8)
        rows, at, left = rows[on], at[on] + 8, left[on] - 8
    return out


class Words:
    """The words of a batch of texts: byte ranges, and the first word and number of words of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        solid = np.frombuffer(data.tobytes().translate(_SOLID), bool)
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        if len(data):  # words don't cross texts
            first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
            begins[first] = solid[first]
            stops[last] = solid[last]
        self.solid = solid
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = np.frombuffer(self.data.tobytes().lower(), np.uint8) if lower else self.data
        return run_hashes(data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` words inside one text."""
        last = len(hashes) - k + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.full(last, np.uint64(k), np.uint64)
        for j in range(k):
            out = out * _BASE + hashes[j : last + j]
            out ^= out >> np.uint64(29)
        inside = np.flatnonzero(self.owner[:last] == self.owner[k - 1 :])
        return inside, mixed(out[inside])


def byte_runs(data: np.ndarray, at: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that ``table`` maps to 1, inside one text each."""
    inside = np.frombuffer(data.tobytes().translate(table), bool)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    begins[at[:-1][full]] = inside[at[:-1][full]]
    stops[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges given by ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[at])


def gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` one after another."""
    first = np.cumsum(sizes) - sizes
    return pool[np.repeat(begin - first, sizes) + np.arange(int(sizes.sum()))]


class UnitCache:
    """Token ids of recurring units (such as words), encoded once per distinct unit and worker.

    ``encode`` maps a list of units to a list of id lists. Units are known by a 64-bit hash. At most
    ``most`` units are held; then the cache starts anew, so that a worker's memory is bounded.
    """

    def __init__(self, encode, most: int = 500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, keys: np.ndarray, units: list[str]) -> None:
        coded = self.encode(units)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        new = np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))
        rows = len(self.begin) + np.arange(len(keys))
        self.ids, self.begin, self.sizes = (np.concatenate(x) for x in ((self.ids, new), (self.begin, begin), (self.sizes, sizes)))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the byte ranges in order, and the number of ids of each range."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, first, back = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            raw, own = data.tobytes(), first[new]
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[own].tolist(), ends[own].tolist())]
            self._add(keys[new], units)
            at = np.searchsorted(self.keys, keys)
        rows = self.rows[at][back]
        sizes = self.sizes[rows]
        return gathered(self.ids, self.begin[rows], sizes), sizes
