"""Bit packing, and encode - write - read against the tokeniser itself."""

import zlib
from unittest.mock import Mock, patch

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SMALL, rows_of
from tokenizers import Tokenizer

from askwell.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert token_files.unpack(raw, bits, 1001).tolist() == ids.tolist()
    assert token_files.bits_for(49_408) == 16 and token_files.bits_for(32_769) == 16 and token_files.bits_for(32_768) == 15


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, before = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def stored(spark, frame, tmp_path, **bounds):
    token_files.write_token_files(frame, f"file://{tmp_path}/out", PATH, **bounds)
    return rows_of(token_files.read_token_files(spark, f"file://{tmp_path}/out"))


def test_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(stored(spark, docs, tmp_path)) == sorted(expected(rows))
    shard = sorted((tmp_path / "out").glob("*.tok"))[0]
    file = token_files.TokenFile(shard.read_bytes())
    one = file.docs // 2
    assert file.document(one).tolist() == [*Tokenizer.from_file(PATH).encode(dict(rows)[int(file.doc_ids[one])], add_special_tokens=False).ids, 1]


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (1, ""), (2, "It's THE end. J̌. <|endoftext|> x<|endoftext|>."), (7, "é. ☃. 漢字 don't q,, ,."), (5, "w " * 60_000), (5, "w " * 60_000), (None, "z")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    key = lambda r: (r[0] is not None, r)
    assert sorted(stored(spark, frame, tmp_path), key=key) == sorted(expected(rows), key=key)
    assert stored(spark, frame.limit(0), tmp_path / "none") == []


@pytest.mark.parametrize("bounds", [{"file_ids": 3_000}, {"file_docs": 7}])
def test_files_are_closed_at_a_bound(spark, tmp_path, bounds):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = stored(spark, docs, tmp_path, **bounds)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert sorted(got) == sorted(expected([tuple(r) for r in docs.collect()]))
    files = [token_files.TokenFile(p.read_bytes()) for p in (tmp_path / "out").glob("*.tok")]
    assert len(files) >= 20
    for f in files:  # the last three documents at most are beyond the bound
        kept = max(f.docs - 3, 0)
        assert f.docs <= bounds.get("file_docs", f.docs) + 2
        assert int(f.starts[kept]) < bounds.get("file_ids", f.n + 1)


def test_a_failed_attempt_counts_for_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string")
    folder = f"file://{tmp_path}/out"
    token_files.write_token_files(docs, folder, PATH)
    before = rows_of(token_files.read_token_files(spark, folder))
    (tmp_path / "out" / "shard-000000-000000-lost.tok").write_bytes(b"half a file")
    assert rows_of(token_files.read_token_files(spark, folder)) == before and len(before) == 50

    def broken(batches):
        yield from batches
        raise RuntimeError("planted")

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["a b"])})
    (tmp_path / "own").mkdir()
    write = token_files._write_shards(f"file://{tmp_path}/own", PATH, 1, 1 << 20, 1 << 20)
    with patch.object(token_files.TaskContext, "get", return_value=Mock(partitionId=lambda: 3)):
        with pytest.raises(RuntimeError, match="planted"):
            list(write(broken(iter([batch]))))
    assert list((tmp_path / "own").iterdir()) == []


def test_random_access_reads_few_bytes(tmp_path):
    ids = np.random.default_rng(1).integers(0, 1 << 17, 40 * token_files.BLOCK)
    sizes = np.full(len(ids) // 1024, 1024)
    with pa.OSFile(str(tmp_path / "one.tok"), "wb") as stream:
        writer = token_files.FileWriter(stream, 17)
        writer.add(pa.array(np.arange(len(sizes))), sizes, ids)
        writer.close()
    read = []

    class Counted:
        def __init__(self, file):
            self.file, self.size = file, file.size

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    with pa.OSFile(str(tmp_path / "one.tok"), "rb") as source:
        file = token_files.TokenFile(Counted(source))
        read.clear()
        assert file.document(700).tolist() == ids[700 * 1024 : 701 * 1024].tolist()
        assert sum(read) == token_files.BLOCK * 17 // 8
        assert file.ids(0, file.n).tolist() == ids.tolist()
        assert [e for _, e in file.groups(docs=9, ids=5000)][:3] == [4, 8, 12] and list(file.groups(ids=10))[1] == (1, 2)
    with pytest.raises(ValueError):
        token_files.TokenFile(b"short")
