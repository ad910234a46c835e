"""Token ids in fixed-width bit-packed files.

A file holds the ids of whole documents in ascending doc_id order, each id in the fewest bits that
hold the vocabulary. Ids are cut into blocks of ``BLOCK`` ids; a block starts at a whole byte and its
offset is stored, so that any block is unpacked alone, with numpy. Layout, little-endian:

    magic "ABITPK01" | blocks | doc ids int64 | doc starts int64 (one more) | null flags uint8
    | block offsets int64 (one more) | footer: bits, block size, docs, ids, blocks as int64, magic

Files lie in a folder that all executors reach. A task writes one range of doc_id as files one after another:
a file is closed once it holds ``FILE_IDS`` ids or ``FILE_DOCS`` documents, so its size and index are bounded at
every size of the corpus (a document isn't cut; one that is longer has a file of its own size). The table
``_shards`` lists the files in order, with their counts. Every attempt of a task names its files anew, and only the
attempt that Spark commits is listed, so a task run twice never counts twice; a failed attempt deletes
its files, and what a lost executor leaves is in no list and never read. Readers fetch a file's index and then
ranges of blocks, never a whole file.

Defined results: null text is an empty text (only the end id); a null doc_id sorts first; repeated
rows are separate documents; no rows give no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import UnitCache, Words, documents, slices, text_bytes

MAGIC = b"ABITPK01"
BLOCK = 1 << 15
END_ID = 1
#: A file is closed with the batch of texts that brings it to one of these.
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
#: Documents and ids that a reader holds at once (one longer document is held alone).
READ_DOCS = 4096
READ_IDS = 1 << 22
#: Files are read by at most as many tasks; with more files, a task reads several.
READ_TASKS = 20_000
SHARDS = "shard long, part long, file string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as a bit string, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    # Eight ids take ``bits`` whole bytes; the id of each of the eight places is or-ed into the bytes it touches.
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits + 8), np.uint8)
    for place in range(8):
        byte, shift = divmod(place * bits, 8)
        value = rows[:, place] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    first = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    value = eights[first >> np.uint64(3)] >> (first & np.uint64(7))
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint32)


class FileWriter:
    """Writes one file block by block; besides the block at hand it holds only the index."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.docs, self.n = stream, bits, 0, 0
        self.doc_ids, self.nulls, self.sizes, self.offsets = [], [], [], [len(MAGIC)]
        self.rest = np.zeros(0, np.int64)
        stream.write(MAGIC)

    def _blocks(self, upto: int) -> None:
        for at in range(0, upto, BLOCK):
            raw = pack(self.rest[at : min(at + BLOCK, upto)], self.bits)
            self.stream.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest = self.rest[upto:]

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The next documents: how many ids each has, and all ids in order."""
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)
        self.docs, self.n = self.docs + len(sizes), self.n + len(ids)
        self.rest = np.concatenate([self.rest, ids])
        self._blocks(len(self.rest) // BLOCK * BLOCK)

    def close(self) -> None:
        self._blocks(len(self.rest))
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype("<i8")
        self.stream.write(np.concatenate(self.doc_ids).astype("<i8").tobytes() + starts.tobytes())
        self.stream.write(np.concatenate(self.nulls).astype(np.uint8).tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.stream.write(np.array([self.bits, BLOCK, self.docs, self.n, len(self.offsets) - 1], "<i8").tobytes() + MAGIC)
        self.stream.close()


class TokenFile:
    """Reads one file: its index at once, documents and blocks by number, each range of blocks in one read.

    ``source`` is the file's bytes or an open ``pyarrow`` file in any store.
    """

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.source.size()
        foot = self.source.read_at(48, size - 48) if size >= 64 else b""
        if foot[-8:] != MAGIC or self.source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.bits, self.block, self.docs, self.n, blocks = np.frombuffer(foot[:40], "<i8").tolist()
        length = 8 * self.docs + 8 * (self.docs + 1) + self.docs + 8 * (blocks + 1)
        index = memoryview(self.source.read_at(length, size - 48 - length))
        take = lambda at, n: np.frombuffer(index[at : at + 8 * n], "<i8")
        self.doc_ids = take(0, self.docs)
        self.starts = take(8 * self.docs, self.docs + 1)
        flags = 8 * (2 * self.docs + 1)
        self.nulls = np.frombuffer(index[flags : flags + self.docs], np.uint8).astype(bool)
        self.offsets = take(flags + self.docs, blocks + 1)

    def block_ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to and without ``last``."""
        begin = int(self.offsets[first])
        raw = memoryview(self.source.read_at(int(self.offsets[last]) - begin, begin))
        cut = (self.offsets[first : last + 1] - begin).tolist()
        sizes = [min(self.block, self.n - k * self.block) for k in range(first, last)]
        return np.concatenate([unpack(raw[a:b], self.bits, n) for a, b, n in zip(cut, cut[1:], sizes)])

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, np.uint32)
        first = begin // self.block
        got = self.block_ids(first, (end - 1) // self.block + 1)
        return got[begin - first * self.block : end - first * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.starts[row]), int(self.starts[row + 1]))

    def groups(self, docs: int = READ_DOCS, ids: int = READ_IDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents that together hold at most so many ids, one document at least."""
        row = 0
        while row < self.docs:
            fits = int(np.searchsorted(self.starts, self.starts[row] + ids, "right")) - 1
            end = min(max(row + 1, fits), row + docs, self.docs)
            yield row, end
            row = end


@lru_cache(maxsize=2)
def _word_tokenizer(path: str) -> tuple[UnitCache, int]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    mark = tokenizer.model.end_of_word_suffix
    closes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    closes[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if mark and token.endswith(mark)]] = True

    def encode(units: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        plain = [i for i, u in enumerate(units) if mark and u.isalpha()]
        odd = [i for i, u in enumerate(units) if not (mark and u.isalpha())]
        # A word of letters only is one merge unit and ends with an id that closes a word, so many
        # of them are encoded as one text and cut apart after these ids.
        for k in range(0, len(plain), 4096):
            rows = plain[k : k + 4096]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(units[i] for i in rows)], add_special_tokens=False)[0].ids)
            parts = np.split(ids, np.flatnonzero(closes[ids])[:-1] + 1) if len(ids) else []
            if len(parts) != len(rows):
                odd += rows
                continue
            for i, part in zip(rows, parts):
                out[i] = part.tolist()
        for i, e in zip(odd, tokenizer.encode_batch_fast([units[i] for i in odd], add_special_tokens=False)):
            out[i] = e.ids
        return out

    return UnitCache(encode, most=1_000_000), len(closes)


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def word_token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and how many each has.

    This vocabulary drops white space and lower-cases before anything else, and a last full stop or
    comma after a letter is a unit of its own. So a text's ids are those of its words in order, and
    each distinct word is encoded once per worker. Capitals are lowered here only where nothing that
    composes with them may follow, and not in batches that hold the mark of a special token.
    """
    cache, _ = _word_tokenizer(path)
    data, at = text_bytes(texts)
    if b"<|" not in data.tobytes():
        alone = np.ones(len(data), bool)
        alone[:-1] = data[1:] < 128
        data = data + (np.uint8(32) * (_CAPITAL[data] & alone)).astype(np.uint8)
    words = Words(data, at)
    starts, ends = words.starts, words.ends
    stop = np.isin(data[ends - 1], (44, 46)) & (ends - starts > 1)
    stop[stop] = _LETTER[data[ends[stop] - 2]]
    cut = ends[stop] - 1
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    ids, sizes = cache.tokens(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ids, np.diff(total[np.searchsorted(starts, at)])


def _write_shards(folder: str, tokenizer: str, end_id: int, file_ids: int, file_docs: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        shard, attempt, own = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        files, root = FileSystem.from_uri(folder)
        bits = bits_for(_word_tokenizer(tokenizer)[1])

        def closed(file: FileWriter) -> pa.RecordBatch:
            file.close()
            row = {"shard": shard, "part": len(own) - 1, "file": own[-1], "n_docs": file.docs, "n_ids": file.n}
            return pa.RecordBatch.from_pylist([row])

        file = None
        try:
            for batch in slices(batches):
                ids, counts = word_token_ids(batch.column("text"), tokenizer)
                if file is None:
                    own.append(f"shard-{shard:06d}-{len(own):06d}-{attempt}.tok")
                    file = FileWriter(files.open_output_stream(f"{root}/{own[-1]}"), bits)
                file.add(batch.column("doc_id"), counts + 1, np.insert(ids.astype(np.int64), np.cumsum(counts), end_id))
                if file.n >= file_ids or file.docs >= file_docs:
                    done, file = file, None
                    yield closed(done)
            if file is not None:
                yield closed(file)
        except BaseException:
            if file is not None and not file.stream.closed:
                file.stream.close()
            for name in own:
                files.delete_file(f"{root}/{name}")
            raise

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS
) -> None:
    """Encode all texts and write the files and a small table of them (``folder``/_shards) to ``folder``.

    ``folder`` is a URI that Spark and ``pyarrow.fs`` both reach. Texts are shuffled once, by range of doc_id.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], "x int").write.parquet(f"{folder}/_made")  # makes the folder, in any store
    ordered = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_shards(folder, tokenizer, end_id, file_ids, file_docs), SHARDS).write.parquet(f"{folder}/_shards")


def _read_shards(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as source:
                    file = TokenFile(source)
                    for row, end in file.groups():
                        starts = file.starts[row : end + 1]
                        ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        cut = (4 * (starts - starts[0])).tolist()
                        raw = memoryview(ids).cast("B")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(file.doc_ids[row:end], pa.int64(), mask=file.nulls[row:end]),
                                "start": pa.array(before + starts[:-1], pa.int64()),
                                "n_tokens": pa.array(np.diff(starts), pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                            }
                        )

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    Only the table of files (one row each) is summed along in one task; then each file goes to a task,
    which reads it by ranges of blocks.
    """
    files = spark.read.schema(SHARDS).parquet(f"{folder}/_shards")
    before = F.sum("n_ids").over(W.orderBy("shard", "part")) - F.col("n_ids")
    tasks = min(max(files.count(), 1), READ_TASKS)
    listed = files.select("file", before.alias("before")).repartition(tasks)
    return listed.mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
