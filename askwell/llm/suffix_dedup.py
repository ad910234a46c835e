"""Removal of text that also occurs earlier, byte by byte, with run-compressed indexes.

Every byte covered by a ``SPAN``-byte string that also starts earlier (in a smaller doc_id, or before in
the same text) is marked. To find such strings anywhere in the corpus without gathering it, texts
are dealt by content: each window of ``SPAN`` bytes has a core, the ``CORE``-byte string in it of the least
hash, and equal windows have equal cores. Windows in a row with the same core form one piece. Cores
that occur once can't be in a repeated window, so only pieces of repeated cores travel, dealt by the
core's hash: all equal windows meet in one task.

In a task, equal pieces are one; of the others, the later half of each core's pieces is streamed against a
run-compressed index (``run_index``) of the earlier half, giving matching statistics, and windows that
match for ``SPAN`` bytes or more are marked; then both halves in the same way, until every piece has
met all earlier ones. All cores of a task share the indexes, each as a class of its own.

Exact copies of whole texts are one text before any of that. A piece that is repeated in the same
batch is marked there, and only its first copy travels. Pieces of a core that occurs over ``HOT`` times
are cut into windows of which ``HOT_WINDOWS`` share a longer core, so that no task gathers a frequent
core's neighbourhoods.

Defined results: null and empty texts keep nothing and lose nothing; rows that share a doc_id are
one document, whose text is the smallest of theirs, and get one result; each row without a doc_id is a
document of its own, later than all others, among them in the order of a hash of their texts (so
doc_ids stay below 2**62); no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import documents, mixed, run_hashes, slices, text_bytes
from askwell.llm.run_index import RunIndex

SPAN = 100
CORE = 32
HOT = 20_000
HOT_WINDOWS = 8
#: Bytes of text worked on at once, and of pieces that share an index.
BATCH, CHUNK = 512 << 10, 3 << 20
_NAMELESS = 1 << 62  # from here on: rows without a doc_id
_P = np.uint64(0x9E3779B97F4A7C15)


def cores(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, number of windows and core's place of each piece (bytes of ``data``)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(n + 1, "<u8", padded, 0, (1,))
    last = n - CORE + 1
    key = np.zeros(last, np.uint64)
    for j in range(0, CORE, 8):
        key = (key ^ eights[j : last + j]) * _P
        key ^= key >> np.uint64(31)
    # Least hash of the cores in each window, the leftmost of equal ones: the hash's upper half over the place.
    least = (key * _P & np.uint64(0xFFFFFFFF00000000)) | np.arange(last, dtype=np.uint64)
    width, reach = SPAN - CORE + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the core of the window at each byte
    inside = np.zeros(len(place), bool)
    long = np.flatnonzero(np.diff(at) >= SPAN)
    edge = np.zeros(len(place) + 1, np.int64)
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - SPAN + 1, -1)
    inside = np.cumsum(edge)[:-1] > 0
    begins = inside.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    begins[at[:-1][long]] = True
    start = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    count = np.flatnonzero(stops) + 1 - start
    return np.searchsorted(at, start, "right") - 1, start, count, place[start]


def _hash(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    return mixed(run_hashes(data, start, start + size) ^ np.uint64(seed)).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The core's hash and the place of each piece."""
    for batch in slices(batches, most=BATCH):
        data, at = text_bytes(batch.column("text"))
        owner, start, count, core = cores(data, at)
        ids = batch.column("uid").to_numpy()
        h = _hash(data, core, np.full(len(core), CORE), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(ids[owner]), pa.array((start - at[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((core - start).astype(np.int32))],
            ["h", "uid", "start", "windows", "core"],
        )


def _finer(data: np.ndarray, hot: np.ndarray, owner, h, start, windows, core) -> tuple[np.ndarray, ...]:
    """Cuts the pieces of frequent cores into groups of windows with a longer string in common.

    Windows whose core lies 8 g to 8 g + 7 bytes after their start all hold the bytes from 8 g before
    the core on, ``SPAN`` less 7 of them; their hash takes the place of the core's.
    """
    few = np.flatnonzero(hot)
    far, near = core[few].astype(np.int64), core[few].astype(np.int64) - windows[few] + 1  # core's distance: first window, last
    place = start[few] + far
    n = far // HOT_WINDOWS - near // HOT_WINDOWS + 1
    row = np.repeat(np.arange(len(few)), n)
    group = (near // HOT_WINDOWS)[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.maximum(group * HOT_WINDOWS, near[row]), np.minimum(group * HOT_WINDOWS + HOT_WINDOWS - 1, far[row])
    key = _hash(data, place[row] - group * HOT_WINDOWS, np.full(len(row), SPAN - HOT_WINDOWS + 1), 2)
    return tuple(
        np.concatenate([old[~hot], new])
        for old, new in ((owner, owner[few][row]), (h, key), (start, place[row] - high), (windows, high - low + 1))
    )


_PIECE = "h long, uid long, start int, stop int, piece binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their bytes; without bytes: bytes of a piece that an earlier one of the batch equals."""
    for batch in slices(batches, most=BATCH):
        data, at = text_bytes(batch.column("text"))
        ids = batch.column("uid").to_numpy()
        spots = batch.column("spots")
        owner = np.repeat(np.arange(len(ids)), np.diff(spots.offsets.to_numpy()))
        flat = spots.flatten()
        h, start, windows, core, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        start = at[owner] + start
        if hot.any():
            owner, h, start, windows = _finer(data, hot, owner, h, start, windows, core)
        if not len(start):
            continue
        size = windows + SPAN - 1
        own = _hash(data, start, size, 3)
        order = np.lexsort((start - at[owner], ids[owner], own, h))
        again = np.zeros(len(order), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
        later = np.zeros(len(order), bool)
        later[order] = again
        raw = data.tobytes()
        pieces = [None if skip else raw[a:b] for skip, a, b in zip(later.tolist(), start.tolist(), (start + size).tolist())]
        begin = start - at[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(ids[owner]), pa.array(begin.astype(np.int32)), pa.array((begin + size).astype(np.int32)), pa.array(pieces, pa.binary())],
            ["h", "uid", "start", "stop", "piece"],
        )


def marked_windows(data: np.ndarray, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether a window starts at each byte that an earlier piece of its group holds too.

    Pieces are distinct and in order inside a group; groups are ascending.
    """
    out = np.zeros(len(data), bool)
    _, low, size = np.unique(groups, return_index=True, return_counts=True)
    high = low + size
    while True:
        several = high - low > 1
        low, high = low[several], high[several]
        if not len(low):
            return out
        middle = (low + high) // 2
        early, late = _rows(low, middle), _rows(middle, high)
        part = lambda rows: (_bytes(data, at, rows), np.concatenate([[0], np.cumsum(np.diff(at)[rows])]))
        index = RunIndex(*part(early), np.repeat(np.arange(len(low)), middle - low))
        text, begin = part(late)
        matched = index.statistics(text, begin, np.repeat(np.arange(len(low)), high - middle)) >= SPAN
        to = np.repeat(at[:-1][late] - begin[:-1], np.diff(begin)) + np.arange(len(text))
        out[to[matched]] = True
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        order = np.argsort(low)
        low, high = low[order], high[order]


def _rows(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _bytes(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return data[_rows(at[:-1][rows], at[1:][rows])]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked byte ranges of pieces that come sorted by core, text and place."""
    held, size = [], 0

    def marks(final: bool):
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        h = table.column("h").to_numpy()
        cut = len(h) if final else int(np.searchsorted(h, h[-1], "left"))  # the last core may go on
        if not cut:
            return None
        rest = table.slice(cut)
        held = rest.to_batches() if rest.num_rows else []
        size = rest.nbytes if rest.num_rows else 0
        return _marks_of(table.slice(0, cut))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                found = marks(False)
                if found is not None:
                    yield found
                elif size > CHUNK:
                    size = 0  # one core only so far; look again after another chunk
    if held:
        found = marks(True)
        if found is not None:
            yield found


def _marks_of(table: pa.Table) -> pa.RecordBatch:
    h, uid = table.column("h").to_numpy(), table.column("uid").to_numpy()
    start, stop = table.column("start").to_numpy().astype(np.int64), table.column("stop").to_numpy().astype(np.int64)
    column = table.column("piece").combine_chunks()
    data, at = text_bytes(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    own = _hash(data, at[:-1], np.diff(at), 3)
    order = np.lexsort((np.arange(len(h)), own, h))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
    out_uid, out_start, out_stop = [uid[again]], [start[again]], [stop[again]]
    first = np.flatnonzero(~again)
    _, back, count = np.unique(h[first], return_inverse=True, return_counts=True)
    first = first[count[back] > 1]
    if len(first):
        text, begin = _bytes(data, at, first), np.concatenate([[0], np.cumsum(np.diff(at)[first])])
        found = marked_windows(text, begin, h[first])
        edge = found.copy()
        edge[1:] &= ~found[:-1]
        edge[begin[:-1]] = found[begin[:-1]]
        last = found.copy()
        last[:-1] &= ~found[1:]
        last[begin[1:] - 1] = found[begin[1:] - 1]
        a, b = np.flatnonzero(edge), np.flatnonzero(last)
        owner = np.searchsorted(begin, a, "right") - 1
        shift = start[first][owner] - begin[owner]
        out_uid.append(uid[first][owner])
        out_start.append(a + shift)
        out_stop.append(b + shift + SPAN)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(out_uid)), pa.array(np.concatenate(out_start).astype(np.int32)), pa.array(np.concatenate(out_stop).astype(np.int32))], ["uid", "start", "stop"]
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        raw, copy = data.tobytes(), batch.column("copy").to_pylist()
        marks = batch.column("marks")
        starts, stops, some = None, None, marks.is_valid().to_numpy(zero_copy_only=False)
        place = marks.offsets.to_numpy()
        flat = marks.values
        starts, stops = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        spans, removed, digests, lists = [], [], [], []
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            text = raw[a:b]
            runs: list[tuple[int, int]] = []
            if copy[i]:
                runs = [(0, b - a)] if b - a >= SPAN else []
            elif some[i]:
                x, y = starts[place[i] : place[i + 1]], stops[place[i] : place[i + 1]]
                order = np.argsort(x, kind="stable")
                x, y = x[order], np.maximum.accumulate(y[order])
                new = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]]))
                runs = list(zip(x[new].tolist(), y[np.append(new[1:], len(x)) - 1].tolist()))
            digest, at_ = hashlib.sha256(), 0
            for x, y in runs:
                digest.update(text[at_:x])
                at_ = y
            digest.update(text[at_:])
            spans.append(len(runs))
            removed.append(sum(y - x for x, y in runs))
            digests.append(digest.hexdigest())
            lists.append([{"start": x, "stop": y} for x, y in runs])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()),
                pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _one_row_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """uid, text: one row per document (see the module's defined results); uid, n of equal rows without a doc_id."""
    nameless = F.lit(_NAMELESS) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(_NAMELESS - 1))
    # The last literal is never taken, but tells Spark that a uid is never null: otherwise it would filter some
    # of the reads of the texts for that, and their shuffles would no longer be one.
    uid = F.coalesce(F.col("doc_id").cast("long"), nameless, F.lit(_NAMELESS))
    plain = documents(docs, "doc_id", "text").select(uid.alias("uid"), "text")
    twice = plain.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return plain, None
    few = plain.join(twice, "uid", "left_semi").groupBy("uid").agg(F.min("text").alias("text"))
    return plain.join(twice, "uid", "left_anti").unionByName(few), twice.where(F.col("uid") >= _NAMELESS)


def _with_equal_rows(found: DataFrame, equal: DataFrame) -> DataFrame:
    """A result for each further row without a doc_id: as a copy it loses all, if it is long enough."""
    more = found.join(equal.select(F.col("uid").alias("of"), "n"), F.col("uid") == F.col("of"))
    more = more.withColumn("copy", F.explode(F.expr("sequence(2L, n)")))
    whole = F.col("n_bytes") >= SPAN
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    copies = {
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")),
        "n_spans": F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long"),
        "kept_sha256": F.when(whole, nothing).otherwise(F.col("kept_sha256")),
        "spans": F.when(whole, span).otherwise(F.col("spans")),
    }
    return found.unionByName(more.withColumns(copies).select(*found.columns))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and stop of each removed run of bytes)."""
    plain, equal = _one_row_each(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Copies of a text: all but the first are removed whole, and take no further part.
    digests = plain.where("text IS NOT NULL").select("uid", F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("uid").alias("first"))
    copies = digests.join(firsts, "digest").where("uid > first").select(F.col("uid").alias("copy_uid"))
    dealt = plain.repartition(parts, "uid")  # the only shuffle of the texts: all steps below share it
    texts = dealt.join(copies, F.col("uid") == F.col("copy_uid"), "left").select("uid", "text", F.col("copy_uid").isNotNull().alias("copy"))
    single = texts.where("NOT copy").select("uid", "text")
    anchors = single.mapInArrow(_anchors, "h long, uid long, start int, windows int, core int")
    often = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    wanted = anchors.join(often, "h").select("uid", F.struct("h", "start", "windows", "core", (F.col("n") > hot).alias("hot")).alias("spot"))
    wanted = wanted.groupBy(F.col("uid").alias("at_uid")).agg(F.collect_list("spot").alias("spots"))
    pieces = single.join(wanted, F.col("uid") == F.col("at_uid")).select("uid", "text", "spots").mapInArrow(_cut, _PIECE)
    here = pieces.where("piece IS NULL").select("uid", "start", "stop")
    met = pieces.where("piece IS NOT NULL").repartition(parts, "h").sortWithinPartitions("h", "uid", "start")
    marks = here.unionByName(met.mapInArrow(_mark, "uid long, start int, stop int"))
    marks = marks.groupBy(F.col("uid").alias("at_uid")).agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    out = texts.join(marks, F.col("uid") == F.col("at_uid"), "left").select("uid", "text", "copy", "marks")
    kinds = "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    doc_id = F.when(F.col("uid") < _NAMELESS, F.col("uid")).alias("doc_id")
    found = out.mapInArrow(_finish, kinds)
    found = found if equal is None else _with_equal_rows(found, equal)
    return found.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
