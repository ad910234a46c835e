"""Questions to hits and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import clean_question
from askwell.operators.context import build_context, build_prompts
from askwell.operators.embed import Embedder, bag_of_words, check_same_embedder
from askwell.operators.postings import PostingsIndex
from askwell.operators.retrieve import DEFAULT_K, nearest, with_chunks


def prepare_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """``query_id``, ``question`` (cleaned before both retrieval and prompt) and the other columns."""
    others = [c for c in questions.columns if c not in ("query_id", "question", text)]
    return questions.select("query_id", clean_question(F.col(text)).alias("question"), *others)


def answer_hits(
    chunks: DataFrame | PostingsIndex,
    questions: DataFrame,
    embedder: Embedder | None = None,
    k: int = DEFAULT_K,
) -> DataFrame:
    """Top ``k`` per question. ``chunks`` may bring their vectors, and then also the
    name of the embedder that made them, or be an index of them."""
    embedder = embedder or bag_of_words()
    asked = embedder(prepare_questions(questions), "question")
    if isinstance(chunks, PostingsIndex):
        check_same_embedder(chunks.chunks(), embedder)
        return chunks.search(asked, k)
    if "vector" in chunks.columns:
        check_same_embedder(chunks, embedder)
    else:
        chunks = embedder(chunks)
    return nearest(chunks, asked, k)


def answer_contexts(
    chunks: DataFrame,
    questions: DataFrame,
    embedder: Embedder | None = None,
    k: int = DEFAULT_K,
    index: PostingsIndex | None = None,
) -> DataFrame:
    """The text of each question's hits. ``chunks`` is read twice (best a stored table), or once with an ``index``."""
    hits = answer_hits(chunks if index is None else index, questions, embedder, k)
    return build_context(with_chunks(hits, chunks, ["content"]))


def answer_prompts(
    chunks: DataFrame,
    questions: DataFrame,
    embedder: Embedder | None = None,
    k: int = DEFAULT_K,
    system: Column | None = None,
    index: PostingsIndex | None = None,
) -> DataFrame:
    """One prompt per question, ready for a language model.

    ``system`` may use any column of ``questions``, such as a configuration's ``system_prompt``.
    """
    contexts = answer_contexts(chunks, questions, embedder, k, index)
    return build_prompts(prepare_questions(questions), contexts, system)
