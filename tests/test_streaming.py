import gzip
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from askwell.operators.store import ChunkStore
from askwell.plans.answer import answer_hits, answer_prompts
from askwell.plans.ingest import distinct_chunks, file_chunks
from askwell.operators.postings import PostingsIndex
from askwell.operators.report import ingest_report
from askwell.sources import listing
from askwell.sources.files import read_files, read_listed_files, stream_files
from askwell.sources.listing import SEEN_SCHEMA, list_files
from askwell.sources.manifest import read_configs
from askwell.streaming.questions import answer_stream, prompt_stream
from askwell.operators.embed import TERM_VECTOR, Embedder, bag_of_words, embedded_schema
from askwell.operators.store import CHUNK_SCHEMA
from askwell.sources.files import reject_reason
from askwell.streaming.refresh import on_timer, refresh, refresh_all, refresh_batch, refresh_changed, refresh_manifest, with_interval


def to_chunks(batch):
    return file_chunks(batch.selectExpr("source", "raw", "0 source_pos", "modified doc_pos"))


def contents(df):
    return {r.content for r in df.collect()}


def test_growing_folder_equals_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = ChunkStore(spark, str(tmp_path / "store"))

    def run():
        query = refresh(
            stream_files(spark, str(folder), max_files=2), to_chunks, store, str(tmp_path / "progress")
        )
        query.awaitTermination()

    for i in range(3):
        (folder / f"a{i}.txt").write_text(f"text {i} " * 200)
    run()
    (folder / "again.txt").write_text("text 0 " * 200)
    (folder / "bad.txt").write_bytes(b"\xff\xff")
    run()
    batches = store.batches()
    run()
    assert store.batches() == batches
    batch = distinct_chunks(to_chunks(read_files(spark, str(folder))))
    assert contents(store.read()) == contents(batch)
    assert store.read().groupBy("chunk_id").count().where("count > 1").count() == 0
    assert len(batches) == 3


def test_failed_batch_keeps_the_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("hello")
    store = ChunkStore(spark, str(tmp_path / "store"))
    args = (store, str(tmp_path / "progress"))
    with pytest.raises(Exception):
        refresh(stream_files(spark, str(folder)), lambda b: b.select("nothing"), *args).awaitTermination()
    assert store.batches() == []
    refresh(stream_files(spark, str(folder)), to_chunks, *args).awaitTermination()
    assert contents(store.read()) == {"hello"}


def test_interval():
    class Writer:
        def trigger(self, **kwargs):
            return kwargs

    assert with_interval(Writer(), 0) == {"availableNow": True}
    assert with_interval(Writer(), 60) == {"processingTime": "60 minutes"}
    with pytest.raises(ValueError):
        with_interval(Writer(), -1)


def test_streamed_answers_equal_batch_answers(spark, tmp_path):
    plain = spark.createDataFrame([("a", "red sky"), ("b", "blue sea")], "chunk_id string, content string")
    chunks = bag_of_words()(plain)
    schema = "query_id bigint, text string"
    for i, question in enumerate(["red", "sea and sky"]):
        spark.createDataFrame([(i, question)], schema).write.parquet(f"{tmp_path}/asked/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked/*")
    answer_stream(stream, lambda: chunks, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    columns = ["query_id", "chunk_id", "distance", "rank"]
    got = spark.read.parquet(f"{tmp_path}/out").select(columns).collect()
    want = answer_hits(chunks, spark.read.schema(schema).parquet(f"{tmp_path}/asked/*")).select(columns)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    index = PostingsIndex(spark, f"{tmp_path}/index", parts=4)
    index.add(chunks)
    answer_stream(stream, lambda: index, f"{tmp_path}/indexed", f"{tmp_path}/progress-4").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/indexed").select(columns).collect())) == sorted(map(tuple, got))
    prompt_stream(stream, lambda: chunks, f"{tmp_path}/prompts", f"{tmp_path}/progress-2").awaitTermination()
    asked = spark.read.schema(schema).parquet(f"{tmp_path}/asked/*")
    prompts = {r.query_id: r.prompt for r in spark.read.parquet(f"{tmp_path}/prompts").collect()}
    assert prompts == {r.query_id: r.prompt for r in answer_prompts(chunks, asked).collect()}
    with pytest.raises(Exception, match="stored vectors"):
        answer_stream(stream, lambda: plain, f"{tmp_path}/none", f"{tmp_path}/progress-3").awaitTermination()


def test_streams_and_new_checkpoints_share_a_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    for name, progress in (("one", "p1"), ("two", "p2"), ("three", "p1-new")):
        folder = tmp_path / name / "nested"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(f"text of {name}")
        refresh(stream_files(spark, str(tmp_path / name)), to_chunks, store, str(tmp_path / progress)).awaitTermination()
    assert contents(store.read()) == {"text of one", "text of two", "text of three"}


def test_only_new_chunks_are_embedded(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), embedded_schema(CHUNK_SCHEMA, TERM_VECTOR))
    seen, words = [], bag_of_words()

    def embed(df, text):
        seen.append(sorted(r[text] for r in df.collect()))
        return words.embed(df, text)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("red sky")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "c.txt").write_bytes(b"\xff")
    rejected = lambda b: b.select("source", reject_reason(F.col("source"), F.col("raw")).alias("reason")).where("reason IS NOT NULL")
    how = {"embedder": Embedder("words", embed), "reports": str(tmp_path / "reports"), "to_rejects": rejected}
    read = lambda: read_files(spark, str(tmp_path / "in"))
    assert refresh_all(read, to_chunks, store, "nightly", 0, **how)
    (tmp_path / "in" / "d.txt").write_text("red sky")  # known text, from another file
    (tmp_path / "in" / "a.txt").write_text("blue sea")  # changed in place
    assert refresh_all(read, to_chunks, store, "nightly", 1, **how)
    assert seen == [["red sky"], ["blue sea"]]
    table = {r.content: (r.source.rsplit("/", 1)[1], r.embedder, len(r.vector)) for r in store.read().collect()}
    assert table == {"red sky": ("d.txt", "words", 2), "blue sea": ("a.txt", "words", 2)}
    rejects = spark.read.parquet(how["reports"] + "/rejects")
    assert {(r.batch, r.reason) for r in rejects.collect()} == {(b, w) for b in (0, 1) for w in ("pdf", "not utf-8")}
    counts = spark.read.parquet(how["reports"] + "/counts")
    assert counts.where("batch = 1").agg(F.sum("chunks")).first()[0] == 2 and counts.where("ingested_at IS NULL").count() == 0


def test_a_failed_run_is_followed_by_the_next(spark, tmp_path):
    runs, errors, done = [], [], threading.Event()

    def run(number):
        runs.append(number)
        if len(runs) == 1:
            raise RuntimeError("source is down")
        done.set()

    query = on_timer(spark, run, str(tmp_path / "progress"), "1 second", errors.append)
    assert done.wait(60)
    query.stop()
    assert runs[:2] == sorted(set(runs))[:2] and [str(e) for e in errors] == ["source is down"]


def config(**change):
    return json.dumps({"bot_name": "b", "sources": [{"type": "local_file", "target": "a.txt"}], **change})


def test_the_manifest_is_read_in_each_run(spark, tmp_path):
    pages = spark.createDataFrame([], "url string, html string, doc_pos int")
    answers = spark.createDataFrame([("https://j", 200, '{"k": 1}', 0)], "url string, status int, body string, doc_pos int")
    files = spark.createDataFrame([("a.txt", "of a", 0), ("b.txt", "of b", 1)], "source string, raw string, doc_pos int")
    store, path, reports = ChunkStore(spark, str(tmp_path / "store")), tmp_path / "bot.json", str(tmp_path / "reports")
    read = lambda: read_configs(spark, str(path))

    def run(number):
        return refresh_manifest(read, lambda: (pages, answers, files), store, "timer", number, reports=reports)

    assert not run(0)  # no configuration
    path.write_text(config())
    assert run(1) and not run(1) and contents(store.read()) == {"of a"}
    for number, broken in enumerate(("{", "", config(sources=[]), config(port=1), config(bot_name=None))):
        path.write_text(broken)
        assert not run(10 + number) and contents(store.read()) == {"of a"}
    path.write_text(config(sources=[{"type": "local_file", "target": t} for t in ("b.txt", "gone.txt")] + [{"type": "dynamic_json", "target": "https://j"}]))
    assert run(2) and contents(store.read()) == {"of a", "of b", "k: 1"}
    rejects = spark.read.parquet(reports + "/rejects")
    assert [(r.batch, r.source, r.reason) for r in rejects.collect()] == [(2, "gone.txt", "missing")]
    runs = spark.read.parquet(reports + "/runs")
    assert {(r.batch, r.chunks, r.distinct_chunks) for r in runs.collect()} == {(1, 1, 1), (2, 2, 2)}


def read_changed(spark, folder, store, seen, reports):
    return refresh_changed(spark, str(folder), read_listed_files, to_chunks, store, seen, reports)


def names(rows):
    return {r.source.rsplit("/", 1)[1] for r in rows}


def test_only_changed_files_are_opened(spark, tmp_path):
    folder, reports = tmp_path / "in", str(tmp_path / "reports")
    (folder / "deep").mkdir(parents=True)
    store, seen = ChunkStore(spark, str(tmp_path / "store")), ChunkStore(spark, str(tmp_path / "seen"), SEEN_SCHEMA, "source")
    for name in ("a.txt", "b.txt", "deep/c with space.txt"):
        (folder / name).write_text(f"text of {name}")
    assert read_changed(spark, folder, store, seen, reports) == 3
    assert read_changed(spark, folder, store, seen, reports) == 0
    (folder / "b.txt").write_text("a new text of b")
    (folder / "deep" / "d.txt").write_text("text of d")
    assert read_changed(spark, folder, store, seen, reports) == 2
    assert contents(store.read()) == {"text of a.txt", "text of b.txt", "text of deep/c with space.txt", "a new text of b", "text of d"}
    assert seen.read().count() == 4 and seen.rows().count() == 5


def test_untouched_files_are_not_opened(spark, tmp_path):
    """The condition on paths leaves files out of the scan, and the listing reads no content."""
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    paths = [r.source for r in list_files(spark, str(tmp_path)).collect()]
    some = read_listed_files(spark, str(tmp_path), sorted(paths)[:2])
    plan = some._jdf.queryExecution().executedPlan()
    assert len(some.collect()) == 2
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 2
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_unreadable_files_are_rejects(spark, tmp_path, monkeypatch):
    folder, reports = tmp_path / "in", str(tmp_path / "reports")
    folder.mkdir()
    store, seen = ChunkStore(spark, str(tmp_path / "store")), ChunkStore(spark, str(tmp_path / "seen"), SEEN_SCHEMA, "source")
    for name in ("a", "b"):
        (folder / f"{name}.txt").write_text(f"text of {name}")
    whole = gzip.compress(("line of text\n" * 5000 + os.urandom(4000).hex()).encode())
    (folder / "cut.txt.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "gone.txt").write_text("soon gone")

    def vanishing(spark, root, paths):
        rows = read_listed_files(spark, root, paths)
        rows._jdf.queryExecution().executedPlan()
        (folder / "gone.txt").unlink(missing_ok=True)
        return rows

    refresh_changed(spark, str(folder), vanishing, to_chunks, store, seen, reports)
    assert contents(store.read()) == {"text of a", "text of b"}
    lost = spark.read.parquet(reports + "/unread").collect()
    assert names(lost) == {"cut.txt.gz", "gone.txt"} and {r.reason for r in lost} == {"unreadable"}
    assert names(seen.read().collect()) == {"a.txt", "b.txt"}
    # Mended, the file is taken in by the next run.
    (folder / "cut.txt.gz").write_bytes(gzip.compress(b"mended"))
    assert read_changed(spark, folder, store, seen, reports) == 1
    assert contents(store.read()) == {"text of a", "text of b", "mended"}


def test_a_slice_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "SLICE_FILES", 2)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.txt").write_text(f"text {i}")
    store, seen = ChunkStore(spark, str(tmp_path / "store")), ChunkStore(spark, str(tmp_path / "seen"), SEEN_SCHEMA, "source")
    assert read_changed(spark, folder, store, seen, None) == 7
    assert contents(store.read()) == {f"text {i}" for i in range(7)} and len(seen.batches()) > 1


def test_a_refresh_reads_its_input_once(spark, tmp_path):
    """Counts, rejects and the upsert share one reading of the landed rows."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    landed = spark.createDataFrame([(f"{i}.txt", f"text {i % 3}", 0, i) for i in range(50)], "source string, raw string, source_pos int, doc_pos int")
    landed = landed.mapInArrow(count, landed.schema)
    store, reports = ChunkStore(spark, str(tmp_path / "store")), str(tmp_path / "reports")
    rejected = lambda b: b.select("source", reject_reason(F.col("source"), F.col("raw")).alias("reason")).where("reason IS NOT NULL")
    assert refresh_batch(landed, file_chunks, store, 0, "w", reports=reports, to_rejects=rejected)
    assert reads.value == 50
    counts = spark.read.parquet(reports + "/counts").drop("ingested_at", "writer", "batch")
    assert sorted(counts.collect()) == sorted(ingest_report(file_chunks(landed)).collect())


def test_equal_texts_have_a_defined_winner(spark):
    rows = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "same")], "source string, raw string")
    got = distinct_chunks(file_chunks(rows.selectExpr("source", "raw", "0 source_pos", "0 doc_pos"))).collect()
    assert [r.source for r in got] == ["c"]
