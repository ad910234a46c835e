"""Mix sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times. The documents of a source
stand in a fixed order (near equal sizes together); the expected copies are summed along it, one
random offset per source is added, and a document is taken once for each whole number its own
share crosses. So copies differ from the expectation by less than one document at any point of
the order, and words by about one document of the largest size.

A source is never gathered: ranks come from counts of (source, size class, salt) groups, of which
one window task orders at most size classes x ``SALTS`` rows per source. The table of sources
itself (one row each) is ordered in one task; sources are what a mix is configured by.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of
its own, ordered last; repeated rows are separate documents; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # all targets together, in sizes of all sources
CAP = 2.0  # most of a source's target, in sizes of the source
SALTS = 64
SEED = "mix-1"


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """One row per source: src_size, target, rate (expected copies of a document), shift (0 to 1).

    Resharing what capped sources leave over, by weight, until none is above its cap, ends at one
    level: each target is ``least(cap, level * weight)``. With sources ordered by cap per weight, the
    level is the largest of what would remain for each if all before it were capped.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    by_ratio = W.orderBy(F.col("top") / F.col("weight"), F.col("place"))
    whole = W.partitionBy()
    totals = sized.groupBy("source").agg(F.sum("size").alias("src_size"))
    placed = totals.withColumn("place", F.row_number().over(in_order) - 1)
    placed = placed.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("top", cap * F.col("src_size"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    level = (F.sum("src_size").over(whole) * share - (F.sum("top").over(before) - F.col("top"))) / (
        F.sum("weight").over(whole) - (F.sum("weight").over(before) - F.col("weight"))
    )
    levelled = placed.withColumn("lambda", level).withColumn("lambda", F.max("lambda").over(whole))
    target = F.least("top", F.col("lambda") * F.col("weight"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit(""))))
    return levelled.select(
        F.col("source").alias("src"),
        "src_size",
        target.alias("target"),
        F.when(F.col("src_size") > 0, target / F.col("src_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0).alias("shift"),
    )


def mixed_copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words), and the columns in ``keep`` as k0, k1, ..."""
    size = F.coalesce(F.size(F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")), F.lit(0)).cast("long")
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]  # by position: names may clash
    have = set(docs.columns)
    found = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in ("doc_id", "text", "source")]
    plain = docs.select(*found, *own)
    sized = plain.withColumn("size", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size)).drop("text")
    digits = F.length(F.bin("size"))
    sized = sized.withColumn("class", digits * 100 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))"))
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % SALTS
    sized = sized.withColumn("salt", salt)
    # A null source as a key of its own, so that the window and the join deal the rows the same way, once.
    sized = sized.withColumn("named", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    keys = ("named", "name", "class", "salt")
    narrow = sized.select("source", *keys, "size")
    groups = narrow.groupBy(*keys).agg(F.count("*").alias("n"))
    along = W.partitionBy("named", "name").orderBy("class", "salt")
    groups = groups.select(*(F.col(k).alias(f"g_{k}") for k in keys), (F.sum("n").over(along) - F.col("n")).alias("before"))
    same = [F.col(k) == F.col(f"g_{k}") for k in keys]
    inside = W.partitionBy(*keys).orderBy("size", "doc_id")
    ranked = sized.withColumn("rn", F.row_number().over(inside)).join(groups, same)
    targets = source_targets(narrow.select("source", "size"), weights, share, cap, seed)
    out = ranked.join(targets, F.col("source").eqNullSafe(F.col("src")))
    upto = F.col("before") + F.col("rn")
    copies = F.floor(F.col("rate") * upto + F.col("shift")) - F.floor(F.col("rate") * (upto - 1) + F.col("shift"))
    return out.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", *(f"k{i}" for i in range(len(keep))), "size", F.col("src_size").alias("source_size"), "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the documents' columns, each document as often as it is taken."""
    columns = docs.columns
    out = mixed_copies(docs, keep=tuple(columns), **how)
    taken = out.where("copies > 0").withColumn("copy_", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return taken.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)))


#: The same rows in DuckDB.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % {SALTS} AS salt FROM documents),
classed AS (SELECT *, length(bin(size)) * 100 + (size >> greatest(length(bin(size)) - 5, 0)) AS class FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS src_size FROM sized GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[place % 3 + 1] AS weight, 2.0::DOUBLE * src_size AS top FROM placed),
levels AS (
  SELECT *, (sum(src_size) OVER () * 1.5::DOUBLE - (sum(top) OVER w - top))
            / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS lambda_
  FROM weighed WINDOW w AS (ORDER BY top / weight, place ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source AS src, src_size, least(top, max(lambda_) OVER () * weight) AS target,
         ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id) AS r FROM classed),
rated AS (
  SELECT *, CASE WHEN src_size > 0 THEN target / src_size ELSE 0 END AS rate
  FROM ranked JOIN targets ON source IS NOT DISTINCT FROM src)
SELECT doc_id, size, src_size AS source_size, target,
       ((floor(rate * r + shift) - floor(rate * (r - 1) + shift))::BIGINT * size)::BIGINT AS taken
FROM rated
"""
