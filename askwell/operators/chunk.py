"""Recursive chunking of whole texts: one row in, its chunks out.

The text is cut before each paragraph break; pieces that are still too long are
cut before each line break, then before each space, then anywhere. Neighbouring
short pieces are packed into chunks of at most ``size`` characters, and a chunk
starts with up to ``overlap`` characters of the one before it.

Kept separators make every chunk a range of its text, so a text is walked over the
offsets of its pieces: two binary searches give a chunk's end and the next one's
start. Texts are taken row by row from Arrow batches, without any shuffle or key, so
a source that owns a third of all rows is spread like any other.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_SIZE = 500
CHUNK_OVERLAP = 100
# Chunks of an Arrow batch that a task returns.
CHUNKS = 10_000

PARAGRAPH, LINE, WORD = "\n\n", "\n", " "


class _Text:
    """A text and where its separators stand, in characters."""

    def __init__(self, text: str):
        self.text, self.codes = text, None

    def starts(self, sep: str, begin: int, end: int) -> list[int]:
        """Where a range is cut: at each separator that doesn't overlap the one before it."""
        if sep == PARAGRAPH:
            found, at = [], self.text.find(sep, begin, end)
            while at >= 0:
                found.append(at)
                at = self.text.find(sep, at + len(sep), end)
            return found
        if self.codes is None:
            self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return (np.flatnonzero(self.codes[begin:end] == ord(sep)) + begin).tolist()


def _pack(bounds: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of a run of short pieces; ``bounds`` are the pieces' starts and the end of the last."""
    begin, last = bounds[0], len(bounds) - 1
    while True:
        at = bisect_right(bounds, begin + size) - 1
        yield begin, bounds[at]
        if at == last:
            return
        # The first piece in reach of the overlap that leaves room for the one that did not fit.
        room = size - (bounds[at + 1] - bounds[at])
        begin = bounds[bisect_left(bounds, bounds[at] - min(overlap, room))]


def _slide(begin: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of a long piece without any separator: a sliding window."""
    stop = max(end - overlap, begin + 1)
    yield from ((at, min(at + size, end)) for at in range(begin, stop, size - overlap))


def _ranges(text: _Text, begin: int, end: int, seps: tuple[str, ...], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    if end - begin <= size:
        yield begin, end
        return
    if not seps:
        yield from _slide(begin, end, size, overlap)
        return
    cuts = text.starts(seps[0], begin, end)
    if not cuts:
        yield from _ranges(text, begin, end, seps[1:], size, overlap)
        return
    bounds = [*([begin] if cuts[0] > begin else []), *cuts, end]
    first = 0
    for i in np.flatnonzero(np.diff(bounds) >= size).tolist():  # a long piece closes the run before it
        if i > first:
            yield from _pack(bounds[first : i + 1], size, overlap)
        yield from _ranges(text, bounds[i], bounds[i + 1], seps[1:], size, overlap)
        first = i + 1
    if first < len(bounds) - 1:
        yield from _pack(bounds[first:], size, overlap)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[str, int]]:
    """The chunks of a text in order, stripped, never empty, with their start offsets.

    A chunk's offset is its first match at or after the previous chunk's end less
    ``overlap``. On repeated lines that can lie before the true place.
    """
    end = 0
    for a, b in _ranges(_Text(text), 0, len(text), (PARAGRAPH, LINE, WORD), size, overlap):
        if chunk := text[a:b].strip():
            at = text.find(chunk, max(0, end - overlap))
            end = at + len(chunk)
            yield chunk, at


def _cut(text: str, keep: list[str], size: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: tuple[list, list, list] = ([], [], [])

            def chunks() -> pa.RecordBatch:
                kept = batch.select(keep).take(pa.array(rows, pa.int64()))
                own = [pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.string(), pa.int32()))]
                for column in (rows, *found):
                    column.clear()
                return pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*keep, "chunk_no", "content", "start_index"])

            for i, value in enumerate(batch.column(text)):
                for number, (chunk, at) in enumerate(split_text(value.as_py() or "", size, overlap)):
                    rows.append(i)
                    for column, item in zip(found, (number, chunk, at)):
                        column.append(item)
                    if len(rows) >= CHUNKS:
                        yield chunks()
            yield chunks()

    return cut


def chunk_texts(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Replace ``text`` by one row per chunk: ``content``, ``chunk_no``, ``start_index``.

    All other columns are kept. Rows whose text is null or blank give no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    keep = [c for c in df.columns if c != text]
    own = (("chunk_no", T.IntegerType()), ("content", T.StringType()), ("start_index", T.IntegerType()))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(*f) for f in own)])
    return df.mapInArrow(_cut(text, keep, size, overlap), schema)
