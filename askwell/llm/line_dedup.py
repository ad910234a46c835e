"""Drop lines that several documents share, keeping each in one of them.

Lines are exploded with their positions and hashed by their normalised form (white space stripped at
both ends, A-Z lower-cased) to 128 bits. Documents are counted per hash; a line whose hash reaches
``min_docs`` documents is dropped everywhere but in the largest doc_id that holds it. What is dropped
travels back as positions, and the remaining lines of a text are joined in their order.

Texts are shuffled once, to meet their positions. Lines are counted with partial aggregation, so a line
of very many documents sends one row per map task. Hashes that make up more than a ``HOT``-th of all
shared occurrences, of which there can be no more than ``HOT``, are broadcast to the lines; only the
others are joined by a shuffle, so no key brings a large share of the lines to one task.

Defined results: null and empty texts are one empty line; a document is a row, so repeated rows count
each; a null doc_id is smaller than every other, and lines held by null ids alone stay; a line that is
repeated within a document counts it once and goes or stays as a whole; no rows give no rows; other
columns are ignored. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import sql_let
from askwell.llm.common import documents, settled, written

MIN_CHARS = 20
MIN_DOCS = 3
HOT = 2_000
#: Lines of an Arrow batch that a task returns.
ROWS = 50_000

_LINES = "doc_id long, mark long, place int, key binary, first boolean"


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and hash of each line whose normalised form has at least ``min_chars`` code points."""
    for place, line in enumerate(text.lower().split(b"\n")):
        key = line.strip()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            yield place, blake2b(key, digest_size=16).digest()


def _exploded(min_chars: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "place", "key", "first"])

        for part in batches:
            ids, marks = part.column("doc_id").to_pylist(), part.column("mark").to_pylist()
            for doc_id, mark, text in zip(ids, marks, part.column("text").cast(pa.binary())):
                seen: set[bytes] = set()
                for place, key in line_keys(text.as_py() or b"", min_chars):
                    rows.append((doc_id, mark, place, key, key not in seen))
                    seen.add(key)
                    if len(rows) >= ROWS:
                        yield batch()
        if rows:
            yield batch()

    return explode


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, mark and place of each line that goes. ``docs``: doc_id, text, mark (a hash of the text)."""
    lines = written(docs.mapInArrow(_exploded(min_chars), _LINES), "lines")
    counts = lines.where("first").groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    shared = written(counts.where(F.col("n") >= min_docs), "shared-lines")
    total = shared.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot, rare = F.broadcast(shared.where(often)), shared.where(~often)
    spots = lines.drop("first")
    found = spots.join(hot, "key").unionByName(spots.join(hot, "key", "left_anti").join(rare, "key"))
    return found.where(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "mark", "place")


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and ``kept``, the text of what stays."""
    plain = documents(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    marked = plain.withColumn("mark", F.xxhash64("text"))
    spots = dropped_lines(marked, min_chars, min_docs).groupBy("doc_id", "mark").agg(F.collect_set("place").alias("gone"))
    spots = spots.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "gone")
    met = marked.join(spots, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    # Positions that stay, by a hash set, then the lines at them: linear in the lines of a text.
    stays = "array_except(sequence(0, size(lines) - 1), gone)"
    joined = sql_let("lines", "split(text, '\\n', -1)", f"array_join(transform({stays}, at -> get(lines, at)), '\\n')")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return met.select(
        "doc_id",
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(joined)).alias("kept"),
    )


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, the digest of what stays."""

    def make() -> DataFrame:
        kept = without_shared_lines(docs, **how)
        return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

    return settled(make, docs.sparkSession, "line-report")


#: The same rows in DuckDB.
ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
exploded AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded),
shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
marked AS (
  SELECT rid, k.doc_id, line, place, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.top AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
