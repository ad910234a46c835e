"""Answering a stream of questions from a snapshot of the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from askwell.operators.embed import Embedder
from askwell.operators.postings import PostingsIndex
from askwell.operators.retrieve import DEFAULT_K
from askwell.plans.answer import answer_hits, answer_prompts
from askwell.streaming.refresh import with_interval


def _per_batch(
    questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval_minutes: int
) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return with_interval(writer, interval_minutes).start()


def _stored(snapshot: Callable[[], DataFrame | PostingsIndex]) -> DataFrame | PostingsIndex:
    stored = snapshot()
    if isinstance(stored, DataFrame) and "vector" not in stored.columns:
        raise ValueError("a stream is answered from stored vectors; embed the chunks when they are stored")
    return stored


def answer_stream(
    questions: DataFrame,
    snapshot: Callable[[], DataFrame | PostingsIndex],
    out: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    k: int = DEFAULT_K,
    interval_minutes: int = 0,
) -> StreamingQuery:
    """Write the hits of each micro-batch of questions below ``out``.

    ``snapshot`` is called per batch, so answers follow the table as it is refreshed. It gives an index,
    of which a batch reads the terms it asks for, or the chunks with their vectors, which a batch scans;
    the corpus is never embedded here. A batch overwrites its own folder, so a replay repeats nothing.
    """
    answer = lambda batch: answer_hits(_stored(snapshot), batch, embedder, k)
    return _per_batch(questions, answer, out, checkpoint, interval_minutes)


def prompt_stream(
    questions: DataFrame,
    snapshot: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    k: int = DEFAULT_K,
    system: Column | None = None,
    interval_minutes: int = 0,
    index: Callable[[], PostingsIndex] | None = None,
) -> StreamingQuery:
    """The same, with a prompt per question in place of its hits; ``index`` is asked for the hits, if given."""

    def answer(batch: DataFrame) -> DataFrame:
        chunks = snapshot() if index else _stored(snapshot)
        return answer_prompts(chunks, batch, embedder, k, system, index() if index else None)

    return _per_batch(questions, answer, out, checkpoint, interval_minutes)
