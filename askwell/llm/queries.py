"""One query per operator over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm import (
    divergence,
    fertility,
    kneser_ney,
    language,
    lexical_search,
    line_dedup,
    minhash,
    mixing,
    neighbours,
    pieces,
    secret_scan,
    suffix_dedup,
    token_files,
)
from askwell.llm.common import bounded_batches, table
from askwell.session import configure, scratch_path

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(configure(spark))
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


@query
def op1_repeated_spans(spark, sf_dir):
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_multiprobe_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


@query
def op3_source_mix(spark, sf_dir):
    mix = mixing.mixed_copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query
def op5_secret_scan(spark, sf_dir):
    found = secret_scan.findings(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))
    return found.select("doc_id", "start", F.length("finding").alias("n_chars"), "score", "secret")


@query
def op6_cross_parsing(spark, sf_dir):
    return language.identified(table(spark, sf_dir, "documents"))


@query
def op7_token_files(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(WORD_VOCABULARY))
    return token_files.read_token_files(spark, folder)


@query
def op8_fertility_rules(spark, sf_dir):
    return fertility.quality_report(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


@query
def op9_sentence_pieces(spark, sf_dir):
    return pieces.encoding_report(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


@query
def op10_kneser_ney(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classified(table(spark, sf_dir, "documents"), trusted)


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark, sf_dir):
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_shared_lines(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {
    "op3_source_mix": mixing.ORACLE,
    "op4_near_duplicates": minhash.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_ranked_search": lexical_search.ORACLE,
    "op13_shared_lines": line_dedup.ORACLE,
}
