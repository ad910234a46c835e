"""How far the sources of a language drift from each other, by the terms they use.

A term is a run of letters and of characters beyond ASCII, A-Z lower-cased. Each task packs the terms of
its texts by length: up to eight bytes make one 64-bit word, up to sixteen two, longer ones go to
buckets of padded bytes by width. Words are sorted by a radix sort of 16-bit digits (numpy's stable
sort of such digits), the other buckets by bytes; runs of equal terms are counted per (lang, source)
group, and documents within them. Runs of several batches are merged the same way, so that a task
sends each term and group about once, however often it occurs.

A language keeps the terms that at least ``min_docs`` of its documents hold. Shares are whole
billionths, with ``SMOOTH`` occurrences added to each kept term; all arithmetic is exact (decimals where
64 bits might not do). A pair of sources is compared over all kept terms of their language: terms are
dealt to blocks of a bounded number of (term, source) cells, each block is a matrix of shares, and
sums of blocks are added up. No pair of sources is made per term.

Defined results: null text, lang and source are ''; every (lang, source) that occurs is a group, also
without any text; a language without kept terms has pairs with value 0; repeated rows are separate
documents; equal values are ranked by the item's UTF-8 bytes; no rows give no rows; other columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import byte_runs, documents, gathered, settled, slices, text_bytes, written

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
#: Least and most cells of a block's matrix of shares (eight bytes each). Between these it has about as many
#: terms as there are sources, so that the sums of a block are no more rows than its cells.
CELLS = (100_000, 2_000_000)
#: Sources compared with all others in a task.
SOURCES = 256
#: Runs that a task holds before it merges them, and sends them if they are still as many.
RUNS = 1_000_000

_TERM_BYTE = bytes(b > 0x7F or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Terms by length: (width, rows, keys); keys are one or two columns of uint64, or padded bytes.

    The first byte is the highest, so numbers sort as bytes do; terms hold no zero bytes, so padding
    keeps them apart.
    """
    sizes = ends - starts
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.ndarray(len(data) + 9, ">u8", wide, 0, (1,))
    cut = (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * np.arange(8, dtype=np.uint64)))[::-1]  # first 1 to 8 bytes
    for low, high in ((0, 8), (8, 16)):
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(rows):
            at, last = starts[rows], sizes[rows] - low
            words = [eights[at].astype(np.uint64)] if low else []
            words.append(eights[at + low].astype(np.uint64) & cut[last - 1])
            yield high, rows, np.stack(words, 1)
    rows, width = np.flatnonzero(sizes > 16), 32
    while len(rows):
        fit = rows[sizes[rows] <= width]
        if len(fit):
            keys = np.zeros((len(fit), width), np.uint8)
            keys[np.arange(width) < sizes[fit][:, None]] = gathered(data, starts[fit], sizes[fit])
            yield width, fit, keys.reshape(-1).view(f"S{width}")
        rows, width = rows[sizes[rows] > width], 2 * width


def radix_order(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` sorted by the columns of ``words``, ties left as they are: 16 bits at a time, lowest first."""
    for column in range(words.shape[1] - 1, -1, -1):
        for shift in (0, 16, 32, 48):
            digits = ((words[:, column] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if digits.min() != digits.max():
                order = order[np.argsort(digits[order], kind="stable")]
    return order


def _term_order(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    return radix_order(keys, order) if keys.ndim == 2 else order[np.argsort(keys[order], kind="stable")]


def _changes(keys: np.ndarray) -> np.ndarray:
    """Whether a sorted key differs from the one before it."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1) if keys.ndim == 2 else keys[1:] != keys[:-1]
    return new


class TermRuns:
    """Counts of (term, group): occurrences and documents, merged as batches come in."""

    def __init__(self):
        self.parts: dict[int, list[tuple]] = {}
        self.size = 0

    def add(self, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        """Count the terms of a batch of lower-cased texts; ``group`` numbers each text's group."""
        starts, ends, owner = byte_runs(data, at, _TERM_BYTE)
        by_group = np.argsort(group, kind="stable")
        rank = np.empty(len(group), np.int64)
        rank[by_group] = np.arange(len(group))
        for width, rows, keys in packed(data, starts, ends):
            doc = rank[owner[rows]]
            order = _term_order(keys, np.argsort(doc, kind="stable"))
            keys, doc = keys[order], doc[order]
            owns = group[by_group[doc]]
            term = _changes(keys)
            run, own = term.copy(), term.copy()
            run[1:] |= owns[1:] != owns[:-1]
            own[1:] |= doc[1:] != doc[:-1]
            first = np.flatnonzero(run)
            n = np.diff(np.append(first, len(keys)))
            self._keep(width, keys[first], owns[first], n, np.add.reduceat(own, first, dtype=np.int64))

    def _keep(self, width: int, *columns: np.ndarray) -> None:
        self.parts.setdefault(width, []).append(columns)
        self.size += len(columns[0])

    def merge(self) -> None:
        parts, self.parts, self.size = self.parts, {}, 0
        for width, held in parts.items():
            keys, group, n, docs = (np.concatenate(c) for c in zip(*held))
            order = _term_order(keys, np.argsort(group, kind="stable"))
            keys, group = keys[order], group[order]
            run = _changes(keys)
            run[1:] |= group[1:] != group[:-1]
            first = np.flatnonzero(run)
            self._keep(width, keys[first], group[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))

    def batches(self, names: list[tuple[str, str]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
        """All runs as rows, and none are left."""
        self.merge()
        langs, sources = (pa.array(c, pa.string()) for c in zip(*names)) if names else (pa.array([], pa.string()),) * 2
        parts, self.parts, self.size = self.parts, {}, 0
        for held in parts.values():
            for keys, group, n, docs in held:
                for i in range(0, len(keys), most):
                    j = slice(i, i + most)
                    raw = keys[j].astype(">u8").view(f"S{8 * keys.shape[1]}")[:, 0] if keys.ndim == 2 else keys[j]
                    terms = pa.array(raw.tolist(), pa.binary()).cast(pa.string())
                    own = pa.array(group[j])
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(own), sources.take(own), terms, pa.array(n[j]), pa.array(docs[j])],
                        names=["lang", "source", "term", "n", "docs"],
                    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, groups = TermRuns(), {}
    for part in slices(batches):
        data, at = text_bytes(part.column("text"))
        own = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
        group = np.array([groups.setdefault(g, len(groups)) for g in own], np.int64)
        runs.add(np.frombuffer(data.tobytes().lower(), np.uint8), at, group)
        if runs.size > RUNS:
            runs.merge()
            if runs.size > RUNS // 2:
                yield from runs.batches(list(groups))
                groups = {}
    yield from runs.batches(list(groups))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n (in the group), total (in the language), lead (one row per lang and term)."""
    counts = docs.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    seen = counts.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(term).alias("df"),
        F.sum("n").over(term).alias("total"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("lead"),
    )
    return seen.where(F.col("df") >= min_docs).drop("df")


def _share(count: Column, all_: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (all + SMOOTH * terms)), exactly."""
    whole = (count + SMOOTH).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, (all_ + SMOOTH * terms).cast("decimal(28,0)")) + 1


def _block_sums(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of differences over a block of terms, of one slice of sources to all others."""
    lang, _, part = (k.as_py() for k in key)
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    base = groups.column("base").to_numpy()
    term = cells.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(base[None, :], len(term.dictionary), 0)
    place = {s: i for i, s in enumerate(names.to_pylist())}
    at = np.fromiter((place[s] for s in cells.column("source").to_pylist()), np.int64, len(cells))
    shares[term.indices.to_numpy(), at] = cells.column("p").to_numpy()
    mine = [i for i, g in enumerate(groups.column("part").to_pylist()) if g == part]
    sums = np.array([np.abs(shares - shares[:, i : i + 1]).sum(0) for i in mine], np.int64).reshape(len(mine), len(names))
    a, b = np.nonzero(np.array(mine)[:, None] != np.arange(len(names))[None, :])
    columns = [pa.array([lang] * len(a), pa.string()), names.take(pa.array(np.array(mine)[a])), names.take(pa.array(b)), pa.array(sums[a, b])]
    return pa.table(columns, names=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module."""
    spark = docs.sparkSession
    columns = documents(docs, "text", "lang", "source")
    plain = columns.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns.columns))

    def make() -> DataFrame:
        kept = written(kept_terms(plain, min_docs), "kept-terms")
        named = plain.select("lang", "source").distinct()
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        whole = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("lead").alias("terms"))
        groups = named.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["own", "whole", "terms"])
        # Parts of at most SOURCES sources (by their order within the language), and blocks of terms.
        in_lang = W.partitionBy("lang")
        placed = groups.withColumn("part", F.floor((F.row_number().over(in_lang.orderBy("source")) - 1) / SOURCES).cast("int"))
        placed = placed.withColumn("sources", F.count("*").over(in_lang))
        base = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("own"), F.col("terms"))).otherwise(0)
        cells = F.least(F.greatest(F.col("sources") * F.col("sources"), F.lit(CELLS[0])), F.lit(CELLS[1]))
        blocks = F.greatest(F.ceil(F.col("terms") * F.col("sources") / cells), F.lit(1)).cast("int")
        parts = F.ceil(F.col("sources") / SOURCES).cast("int")
        groups = written(placed.select("*", base.alias("base"), blocks.alias("blocks"), parts.alias("parts")), "groups")

        shared = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own"), F.col("terms")))
        cells = shared.select(
            "lang", "source", "term", "p",
            F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.expr("sequence(0, parts - 1)")).alias("slice"),
        )
        sides = groups.select("lang", "source", "base", "part", "blocks", F.explode(F.expr("sequence(0, parts - 1)")).alias("slice"))
        sides = sides.select("lang", "source", "base", "part", "slice", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        key = ["lang", "block", "slice"]
        sums = cells.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_block_sums, "lang string, source string, item string, value long")
        pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

        far = shared.withColumn("value", F.col("p") - _share(F.col("total"), F.col("whole"), F.col("terms"))).where("value > 0")
        terms = far.select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
        group = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        terms = terms.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
        pairs = pairs.withColumn("rank", F.row_number().over(group))
        out = ["lang", "source", "part", "item", "value", "rank"]
        return pairs.select(*out).unionByName(terms.select(*out))

    return settled(make, spark, "divergence")


#: The same rows in DuckDB.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS own FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(o.own, 0) + {SMOOTH} * l.v) AS p,
         1 + ({SCALE}::HUGEINT * (k.total + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
