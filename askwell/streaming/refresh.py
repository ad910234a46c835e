"""Refreshing the chunk table once or on a timer."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from askwell.operators.embed import Embedder
from askwell.operators.report import ingest_report
from askwell.operators.store import ChunkStore
from askwell.plans.ingest import distinct_chunks, ingest_manifest
from askwell.session import delete, scratch_path, written
from askwell.sources.listing import changed, list_files, slices, unread
from askwell.sources.manifest import config_problem

ToChunks = Callable[[DataFrame], DataFrame]


def with_interval(writer: DataStreamWriter, interval_minutes: int) -> DataStreamWriter:
    """0 takes what has arrived and stops; n runs every n minutes."""
    if interval_minutes < 0:
        raise ValueError("interval_minutes must not be negative")
    if interval_minutes == 0:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{interval_minutes} minutes")


def with_vectors(chunks: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors for distinct chunks: those of known ids are taken from the table, only new ids are embedded."""
    known = stored.where(F.col("embedder") == embedder.name).select("chunk_id", "vector", "embedder")
    new = embedder(chunks.join(known.select("chunk_id"), "chunk_id", "left_anti"))
    return chunks.join(known, "chunk_id").unionByName(new)


def refresh_rows(
    rows: DataFrame,
    store: ChunkStore,
    number: int,
    writer: str,
    embedder: Embedder | None = None,
    reports: str | None = None,
    rejects: DataFrame | None = None,
) -> bool:
    """Upsert the chunk rows of one batch, embed what is new, and write what was taken in and turned away.

    The rows are computed once, into a scratch table that the upsert and the counts read. Below
    ``reports``, each batch has its own folder of counts per source (``counts``, with ``ingested_at``),
    of counts of the run (``runs``, observed while the rows were written) and of rejected inputs
    (``rejects``); a batch that is written again replaces its own.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "chunk-rows")
    taken, kept = Observation("taken"), Observation("kept")
    try:
        rows = written(rows.observe(taken, F.count("*").alias("chunks")), path)
        chunks = distinct_chunks(rows)
        if embedder is not None:
            chunks = with_vectors(chunks, store.read(), embedder)
        chunks = chunks.observe(kept, F.count("*").alias("distinct_chunks"))
        if reports is not None:
            own = f"writer={writer}/batch={number}"
            counts = ingest_report(rows).withColumn("ingested_at", F.current_timestamp())
            counts.write.mode("overwrite").parquet(f"{reports}/counts/{own}")
            if rejects is not None:
                rejects.write.mode("overwrite").parquet(f"{reports}/rejects/{own}")
        changed_ = store.upsert(chunks, number, writer)
        if reports is not None:
            run = [(taken.get["chunks"], kept.get["distinct_chunks"] if changed_ else 0)]
            spark.createDataFrame(run, "chunks long, distinct_chunks long").write.mode("overwrite").parquet(f"{reports}/runs/{own}")
        return changed_
    finally:
        delete(spark, path)


def refresh_batch(
    landed: DataFrame,
    to_chunks: ToChunks,
    store: ChunkStore,
    number: int,
    writer: str,
    embedder: Embedder | None = None,
    reports: str | None = None,
    to_rejects: ToChunks | None = None,
) -> bool:
    """Chunk one batch of landed inputs and upsert it; the inputs are read once, also for the rejects."""
    if store.holds(number, writer):
        return False
    turned_away = to_rejects is not None and reports is not None
    landed = landed.persist() if turned_away else landed
    try:
        return refresh_rows(to_chunks(landed), store, number, writer, embedder, reports, to_rejects(landed) if turned_away else None)
    finally:
        if turned_away:
            landed.unpersist()


def refresh(
    landed: DataFrame,
    to_chunks: ToChunks,
    store: ChunkStore,
    checkpoint: str,
    interval_minutes: int = 0,
    embedder: Embedder | None = None,
    reports: str | None = None,
    to_rejects: ToChunks | None = None,
) -> StreamingQuery:
    """Chunk what arrives in ``landed`` and upsert it, batch by batch.

    A batch is known by the stream's id, which its checkpoint keeps, and its number, so one that
    is replayed after a failure changes nothing, and other streams, or a stream with a new
    checkpoint, never meet its numbers. A failed batch fails the query and leaves the table as
    it was; started again, the stream goes on with that batch.
    """
    started, own = threading.Event(), []

    def write(batch: DataFrame, number: int) -> None:
        started.wait()
        refresh_batch(batch, to_chunks, store, number, own[0], embedder, reports, to_rejects)

    writer = landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = with_interval(writer, interval_minutes).start()
    own.append(str(query.id))
    started.set()
    return query


def refresh_all(
    read: Callable[[], DataFrame], to_chunks: ToChunks, store: ChunkStore, writer: str, number: int, **how
) -> bool:
    """Read every source anew and upsert all of it.

    A file stream sees a path once; a run of this sees what stands there now. Chunks that are in the
    table already keep their vectors. ``refresh_changed`` opens only what has changed.
    """
    return refresh_batch(read(), to_chunks, store, number, writer, **how)


def refresh_manifest(
    read_configs: Callable[[], DataFrame],
    read_landed: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    store: ChunkStore,
    writer: str,
    number: int,
    embedder: Embedder | None = None,
    reports: str | None = None,
) -> bool:
    """Upsert what the configurations list now, out of what has landed (pages, responses, files).

    Both are read anew in each run. If the configurations are missing, or none of them is usable and
    lists a source, the run ends here and the table stays as it is. Of several configurations an
    unusable one lists nothing and is reported.
    """
    if store.holds(number, writer):
        return False
    try:
        configs = read_configs()
    except AnalysisException:  # no such file
        return False
    path = scratch_path(configs.sparkSession, "configs")
    try:
        configs = written(configs, path)  # as they are now, for the whole run
        if configs.where(config_problem(configs).isNull() & (F.size("sources") > 0)).isEmpty():
            return False
        rows, rejects = ingest_manifest(configs, *read_landed())
        return refresh_rows(rows, store, number, writer, embedder, reports, rejects)
    finally:
        delete(store.spark, path)


def refresh_changed(
    spark: SparkSession,
    root: str,
    read: Callable[[SparkSession, str, list[str]], DataFrame],
    to_chunks: ToChunks,
    store: ChunkStore,
    seen: ChunkStore,
    reports: str | None = None,
    **how,
) -> int:
    """Read the files below ``root`` that are new or have changed since they were last taken in.

    The listing reads no content. ``seen`` holds path, time and length of every file taken in
    (``SEEN_SCHEMA``, keyed by ``source``). ``read(spark, root, paths)`` gives the rows of these files alone,
    with the path as ``source_file``; files are taken in slices of a bounded number. A file that vanished
    or can't be read yields nothing, is written below ``reports`` as a reject, and is tried again in the next
    run. A run that failed half-way goes on with the files that aren't in ``seen``.
    Returns the number of files that were to be opened.
    """
    opened, path = 0, scratch_path(spark, "changed")
    try:
        todo = written(changed(list_files(spark, root), seen.read()), path)
        for part in slices(todo):
            paths = [r.source for r in part.select("source").collect()]
            landed, own = read(spark, root, paths).persist(), uuid.uuid4().hex
            try:
                refresh_batch(landed.drop("source_file"), to_chunks, store, 0, own, reports=reports, **how)
                lost = unread(part, landed.select(F.col("source_file").alias("source")))
                if reports is not None:
                    lost.write.parquet(f"{reports}/unread/writer={own}/batch=0")
                seen.upsert(part.join(lost.select("source"), "source", "left_anti"), 0, own)
                opened += len(paths)
            finally:
                landed.unpersist()
        return opened
    finally:
        delete(spark, path)


def on_timer(
    spark: SparkSession,
    run: Callable[[int], object],
    checkpoint: str,
    every: str = "60 minutes",
    on_error: Callable[[Exception], None] = lambda error: None,
) -> StreamingQuery:
    """A run per trigger, with the trigger's number; one that fails is reported and the next trigger runs again.

    ``run`` is one of the refreshes that read their sources anew, such as ``refresh_manifest``.
    """

    def tick(batch: DataFrame, number: int) -> None:
        try:
            run(number)
        except Exception as error:  # noqa: BLE001  one failed run must not end the timer
            on_error(error)

    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
