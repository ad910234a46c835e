"""The library's operators as queries over one folder of parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.functions.numbers import cosine_distance
from askwell.functions.text import clean_question, content_id, has_http_scheme, url_host
from askwell.operators.cells import VectorCells
from askwell.operators.chunk import chunk_texts
from askwell.operators.dedup import last_wins, with_content_id
from askwell.operators.embed import (
    TERM_VECTOR,
    bag_of_words,
    embedded_schema,
    hashed_words,
    term_counts,
)
from askwell.operators.flatten import all_leaves
from askwell.operators.report import ingest_report, reject_report, rejects
from askwell.operators.postings import PostingsIndex
from askwell.operators.retrieve import nearest, with_chunks
from askwell.operators.store import CHUNK_SCHEMA, ChunkStore, replace_by_id
from askwell.plans import ingest as plan
from askwell.plans.answer import answer_contexts, answer_hits, answer_prompts
from askwell.plans.shape import spread
from askwell.session import configure, scratch_path, written
from askwell.sources import files, manifest, pages, responses
from askwell.streaming.questions import answer_stream
from askwell.sources.listing import SEEN_SCHEMA
from askwell.streaming.refresh import refresh, refresh_changed, refresh_manifest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__.removesuffix("_query")] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- ids, cleaning, checks


@query
def content_ids(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", content_id(F.col("text")).alias("chunk_id"))


@query
def dedup_last_wins(spark, sf_dir):
    ids = with_content_id(_table(spark, sf_dir, "documents"), "text")
    return last_wins(ids.select("chunk_id", "source", "doc_id"), ["source", "doc_id"])


def _distinct_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(
        F.col("text").alias("content"), "source", "doc_id"
    )
    return last_wins(with_content_id(docs), ["source", "doc_id"])


def _stored_documents(spark, sf_dir):
    """The distinct documents, written once and read back."""
    return written(spread(_distinct_documents(spark, sf_dir)), scratch_path(spark, "documents"))


def _indexed_documents(spark, sf_dir):
    """An index of the distinct documents."""
    index = PostingsIndex(spark, scratch_path(spark, "index"), parts=32, shard_postings=100_000)
    index.add(bag_of_words()(spread(_distinct_documents(spark, sf_dir))))
    return index


@query
def sanitize_queries(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", clean_question(F.col("text")).alias("question"))


# What a page's address is turned into, by the rest of its number (fixed values).
ODD_ADDRESSES = (
    "http://LOCALHOST:8000/a", "http://user:pw@127.0.0.1/", "https://[::1]:9/x", "http://0.0.0.0", "no-host", "ftp://files.example.org/a.pdf",
    "http://my_host.example.com/a", "http://a.example.com/q?x=a|b", "http://a b.example.com/{id}", "http://münchen.example.de/x.pdf", "HTTP://Upper.Example.com",
)


def _addressed_pages(spark, sf_dir):
    """The pages, two thirds of them with an address that is odd, local or no address at all."""
    n = len(ODD_ADDRESSES)
    odd = F.element_at(F.array(*map(F.lit, ODD_ADDRESSES)), (F.col("page_id") % n + 1).cast("int"))
    odd = F.concat(odd, F.when(odd.endswith("/a"), F.col("page_id").cast("string")).otherwise(""))
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(odd)
    return _table(spark, sf_dir, "pages").withColumn("url", url)


@query
def pages_per_host(spark, sf_dir):
    hosts = _addressed_pages(spark, sf_dir).select(url_host(F.col("url")).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("pages"))


@query
def safe_pages(spark, sf_dir):
    safe = pages.safe_pages(_addressed_pages(spark, sf_dir))
    return safe.select("page_id", url_host(F.col("url")).alias("host"))


@query
def url_scheme_check(spark, sf_dir):
    return _addressed_pages(spark, sf_dir).select(
        "page_id", "url", has_http_scheme(F.col("url")).alias("accepted")
    )


@query
def route_by_suffix(spark, sf_dir):
    return _addressed_pages(spark, sf_dir).select(
        "page_id", files.suffix_route(F.col("url")).alias("route")
    )


# --- vectors and retrieval


def _centroids(vectors):
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    return vectors.groupBy("label").agg(vector_to_array(mean).alias("centroid"))


@query
def cosine_pairs(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    pairs = vectors.join(_centroids(vectors), "label")
    distance = cosine_distance(F.col("embedding"), F.col("centroid"))
    return pairs.select("vec_id", "label", F.round(distance, 6).alias("distance"))


@query
def retrieve_dense_top5(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    asked = _centroids(vectors).select(
        F.col("label").alias("query_id"), F.col("centroid").alias("vector")
    )
    stored = spread(vectors.select("vec_id", F.col("embedding").alias("vector")))
    hits = nearest(stored, asked, chunk_id="vec_id")
    return hits.select(
        "query_id",
        F.col("chunk_id").alias("vec_id"),
        F.round("distance", 6).alias("distance"),
        "rank",
    )


@query
def retrieve_cells_top5(spark, sf_dir):
    """The hits of ``retrieve_dense_top5`` from vectors stored by cell."""
    index = VectorCells(spark, scratch_path(spark, "cells"))
    index.build(_table(spark, sf_dir, "embeddings"), chunk_id="vec_id", vector="embedding")
    hits, _ = index.search(_centroids(_table(spark, sf_dir, "embeddings")), query_id="label", vector="centroid")
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query
def term_vectors(spark, sf_dir):
    docs = spread(_distinct_documents(spark, sf_dir).select("chunk_id", "content"))
    counted = docs.select("chunk_id", term_counts("content").alias("v"))
    return counted.select("chunk_id", F.explode_outer("v").alias("t")).select("chunk_id", "t.*")


def _questions(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hit_columns(hits, *more):
    return hits.select(
        "query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"), *more
    )


@query
def retrieve_text_top5(spark, sf_dir):
    docs = spread(_distinct_documents(spark, sf_dir))
    return _hit_columns(answer_hits(docs, _questions(spark, sf_dir)))


@query
def retrieve_with_source(spark, sf_dir):
    # Written once: the search and the lookup of the hits' sources read the same distinct rows.
    docs = _stored_documents(spark, sf_dir)
    hits = answer_hits(docs, _questions(spark, sf_dir))
    return _hit_columns(with_chunks(hits, docs, ["source", "doc_id"]), "source", "doc_id")


@query
def retrieve_postings_top5(spark, sf_dir):
    """The hits of ``retrieve_text_top5`` from a stored index; half of the documents are added later, some again."""
    docs = bag_of_words()(spread(_distinct_documents(spark, sf_dir)))
    index = PostingsIndex(spark, scratch_path(spark, "index"), parts=32, shard_postings=100_000)
    index.add(docs.where(F.col("chunk_id") < "a"))
    index.add(docs)
    return _hit_columns(answer_hits(index, _questions(spark, sf_dir)))


@query
def retrieve_hashed_top5(spark, sf_dir):
    docs = spread(_distinct_documents(spark, sf_dir))
    return _hit_columns(answer_hits(docs, _questions(spark, sf_dir), hashed_words()))


# --- chunking


@query
def chunk_documents(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunk_texts(docs)


def _landed_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return spread(
        docs.select(
            F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
            .alias("source"),
            F.col("text").alias("raw"),
            F.lit(2).alias("source_pos"),
            F.col("doc_id").alias("doc_pos"),
        )
    )


def _landed_pages(spark, sf_dir):
    return spread(
        _table(spark, sf_dir, "pages").select(
            "url", "html", F.lit(0).alias("source_pos"), F.col("page_id").alias("doc_pos")
        )
    )


def _landed_responses(spark, sf_dir):
    """API responses: one per event, with a status that follows from the event."""
    events = spread(_table(spark, sf_dir, "events"))
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("value") < 1, 401)
        .when(F.col("value") < 2, 403)
        .when(F.col("value") < 3, 404)
        .otherwise(200)
    )
    return events.select(
        F.concat(F.lit("https://api.example.com/users/"), F.col("user_id")).alias("url"),
        status.alias("status"),
        F.col("props").alias("body"),
        F.lit(1).alias("source_pos"),
        F.col("event_id").alias("doc_pos"),
    )


@query
def file_chunks(spark, sf_dir):
    return plan.file_chunks(_landed_files(spark, sf_dir)).select(
        "source", "type", "chunk_no", "chunk_id", "start_index"
    )


@query
def page_blocks(spark, sf_dir):
    html = spread(_table(spark, sf_dir, "pages"))
    blocks = html.select(
        "page_id", F.posexplode_outer(pages.page_blocks(F.col("html"))).alias("block_no", "block")
    )
    return blocks.where(F.col("block").isNotNull())


@query
def page_text(spark, sf_dir):
    html = spread(_table(spark, sf_dir, "pages"))
    return html.select("page_id", pages.page_text(F.col("html")).alias("text"))


@query
def web_chunks(spark, sf_dir):
    return plan.page_chunks(_landed_pages(spark, sf_dir)).select(
        F.col("doc_pos").alias("page_id"), "source", "type", "chunk_no", "start_index", "content"
    )


# --- JSON

# Bodies that an event's number picks from (fixed values).
ODD_BODIES = (
    "{}", "[]", "0", "0.0", "false", '""', "null", '[[],{},[{}]]', '{"a":null,"b":"  ","c":"\\t\\n"}', "not json", '{"a":', "",
    '{"a":"  USER\\u00a0","b":null}', '[null,"USER"," "]', '" USER "', '{"a":[{"b":{}},{"b":"\\u3000USER\\u0085"}]}', "-USER", '{"t":true,"n":0,"f":false}',
)


@query
def json_flatten(spark, sf_dir):
    """Every event as a nested payload, down to its leaves."""
    events = spread(_table(spark, sf_dir, "events"))
    payload = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"),
            F.struct(
                F.col("user_id").alias("id"),
                F.array(F.struct("value"), F.struct(F.lit(0.5).alias("value"))).alias("readings"),
                (F.col("user_id") % 2 == 0).alias("even"),
            ).alias("user"),
            F.array(F.array("event_id", "user_id"), F.array("event_id")).alias("ids"),
        )
    )
    flat = all_leaves(events.select("event_id", payload.alias("body")), "body")
    return flat.select("event_id", "path", "content")


@query
def json_leaf_docs(spark, sf_dir):
    return responses.leaf_documents(_landed_responses(spark, sf_dir)).select(
        F.col("doc_pos").alias("event_id"), "source", "type", "content"
    )


@query
def json_odd_payloads(spark, sf_dir):
    """Payloads that hold nothing, blank and null leaves, and white space around values, one per event."""
    body = F.element_at(F.array(*map(F.lit, ODD_BODIES)), (F.col("event_id") % len(ODD_BODIES) + 1).cast("int"))
    body = F.replace(body, F.lit("USER"), F.col("user_id").cast("string"))
    events = _table(spark, sf_dir, "events")
    landed = events.select("event_id", F.lit("u").alias("url"), F.lit(200).alias("status"), body.alias("body"))
    return responses.leaf_documents(landed).select("event_id", "content")


@query
def response_routing(spark, sf_dir):
    landed = _landed_responses(spark, sf_dir)
    return landed.select(
        F.col("doc_pos").alias("event_id"),
        "status",
        responses.route(F.col("status")).alias("route"),
    )


# --- the whole ingest


def _page_configs(spark, sf_dir):
    """One configuration per page, as the JSON text a user would write."""
    sources = F.array(
        F.struct(F.lit("static_url").alias("type"), F.col("url").alias("target")),
        F.struct(F.lit("dynamic_json").alias("type"), F.concat("url", F.lit("/api")).alias("target")),
        F.struct(
            F.lit("local_file").alias("type"),
            F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("target"),
        ),
    )
    text = F.to_json(
        F.struct(url_host(F.col("url")).alias("bot_name"), sources.alias("sources"))
    )
    rows = _table(spark, sf_dir, "pages").select("page_id", text.alias("config"))
    return manifest.parse_configs(rows, "config")


@query
def source_manifest(spark, sf_dir):
    listed = manifest.source_manifest(_page_configs(spark, sf_dir))
    return listed.select(
        "page_id", "bot_name", "port", "refresh_interval_minutes", "source_pos", "type", "target"
    )


@query
def missing_targets(spark, sf_dir):
    """File targets, one per page, that no landed document carries the number of (files are named by their length)."""
    listed = manifest.source_manifest(_page_configs(spark, sf_dir))
    landed = _table(spark, sf_dir, "documents").select(
        F.concat(F.col("n_chars").cast("string"), F.lit(".txt")).alias("path")
    )
    return manifest.missing_targets(listed, landed).select("page_id", "target")


def _ingested(spark, sf_dir):
    return plan.ingest(
        _landed_pages(spark, sf_dir), _landed_responses(spark, sf_dir), _landed_files(spark, sf_dir)
    )


@query
def ingest_all(spark, sf_dir):
    return plan.distinct_chunks(_ingested(spark, sf_dir)).select(
        "chunk_id", "source", "type", "start_index", F.char_length("content").alias("n_chars")
    )


@query
def ingest_report_query(spark, sf_dir):
    return ingest_report(_ingested(spark, sf_dir))


@query
def reject_report_query(spark, sf_dir):
    web, api, texts = (
        _addressed_pages(spark, sf_dir),
        _landed_responses(spark, sf_dir),
        _landed_files(spark, sf_dir),
    )
    unsafe = F.when(~pages.is_safe_url(F.col("url")), F.lit("unsafe host"))
    return reject_report(
        rejects(web, F.col("url"), "url", unsafe),
        rejects(api, F.col("url"), "json", responses.reject_reason(F.col("status"), F.col("body"))),
        rejects(texts, F.col("source"), "file", files.reject_reason(F.col("source"), F.col("raw"))),
    )


PDF, GONE = "page-{}.pdf", "gone-{}.txt"


def _named(pattern: str, number: str):
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), F.col(number).cast("string"), F.lit(after))


def _config(name, port, *sources):
    listed = F.array(*(F.struct(F.lit(kind).alias("type"), target.alias("target")) for kind, target in sources))
    return F.to_json(F.struct(name.alias("bot_name"), F.lit(port).alias("port"), listed.alias("sources")))


def _manifest_configs(spark, sf_dir):
    """A configuration per page and one per document, and for each page two more that are of no use.

    A page's lists its address, an odd address, an API, a PDF and a file that never came; a document's
    lists its file.
    """
    own = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("own"))
    pages_ = own.join(_addressed_pages(spark, sf_dir).select("page_id", "url"), "page_id")
    api = F.concat(F.lit("https://api.example.com/users/"), F.col("page_id").cast("string"))
    wanted = (
        ("static_url", F.col("own")), ("static_url", F.col("url")), ("dynamic_json", api),
        ("local_file", _named(PDF, "page_id")), ("local_file", _named(GONE, "page_id")),
    )
    good = pages_.select(_config(_named("bot-{}", "page_id"), 9000, *wanted).alias("config"))
    unnamed = pages_.select(_config(F.lit(""), 9000, *wanted).alias("config"))
    bad_port = pages_.select(_config(_named("bot-{}", "page_id"), 80, *wanted).alias("config"))
    docs = _table(spark, sf_dir, "documents")
    files_ = docs.select(_config(_named("docs-{}", "doc_id"), 9000, ("local_file", _named("{}.txt", "doc_id"))).alias("config"))
    return manifest.parse_configs(good.unionAll(unnamed).unionAll(bad_port).unionAll(files_), "config")


def _manifest_landed(spark, sf_dir):
    """All pages, at their own and at odd addresses; all responses; all documents as text files and all pages as PDFs."""
    pages_ = _table(spark, sf_dir, "pages").select("url", "html", F.col("page_id").alias("doc_pos"))
    odd = _addressed_pages(spark, sf_dir).select("url", "html", F.col("page_id").alias("doc_pos"))
    texts = _table(spark, sf_dir, "documents").select(
        _named("{}.txt", "doc_id").alias("source"), F.col("text").alias("raw"), F.col("doc_id").alias("doc_pos")
    )
    pdfs = pages_.select(_named(PDF, "doc_pos").alias("source"), F.col("html").alias("raw"), "doc_pos")
    odd = odd.join(pages_.select("url", "doc_pos"), ["url", "doc_pos"], "left_anti")
    answers = _landed_responses(spark, sf_dir).drop("source_pos")
    return pages_.unionByName(odd), answers, texts.unionByName(pdfs)


def _manifest_run(spark, sf_dir):
    return plan.ingest_manifest(_manifest_configs(spark, sf_dir), *_manifest_landed(spark, sf_dir))


@query
def ingest_manifest(spark, sf_dir):
    """What configurations list, out of all that has landed."""
    chunks, _ = _manifest_run(spark, sf_dir)
    return plan.distinct_chunks(chunks).select("chunk_id", "source", "type", "start_index", F.char_length("content").alias("n_chars"))


@query
def ingest_manifest_rejects(spark, sf_dir):
    """And what it turned away, counted by type and reason."""
    _, turned_away = _manifest_run(spark, sf_dir)
    return reject_report(turned_away)


# --- store and streams


def _labelled(spark, sf_dir):
    """The documents that came in again with a label, as a second batch."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(
        F.col("text").alias("content"),
        F.concat(F.lit("labelled/"), F.col("quality").cast("string")).alias("source"),
        "doc_id",
    )
    return last_wins(with_content_id(rows), ["source", "doc_id"])


@query
def upsert_two_batches(spark, sf_dir):
    first, second = _distinct_documents(spark, sf_dir), _labelled(spark, sf_dir)
    return replace_by_id(first, second).select("chunk_id", "source", "doc_id")


def _store_rows(docs):
    return docs.withColumns({"type": F.lit("file"), "start_index": F.lit(None).cast("int")})


@query
def store_two_batches(spark, sf_dir):
    """The same through batches on disk; a replay of the first one changes nothing."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.upsert(_store_rows(_distinct_documents(spark, sf_dir)), 1)
    store.upsert(_store_rows(_labelled(spark, sf_dir)), 2)
    store.upsert(_store_rows(_distinct_documents(spark, sf_dir)), 1)
    return store.read().select("chunk_id", "source")


@query
def store_empty_batch(spark, sf_dir):
    """Rows of the table, and whether it was written to, after a batch, one without rows, and a replay."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    rows = _store_rows(_distinct_documents(spark, sf_dir))
    steps = [("first", rows, 0), ("empty", rows.where("content IS NULL"), 1), ("replay", rows, 0)]
    out = None
    for name, batch, number in steps:
        wrote = store.upsert(batch, number)
        after = store.read().agg(F.count("*").alias("rows")).select(F.lit(name).alias("step"), F.lit(wrote).alias("wrote"), "rows")
        out = after if out is None else out.unionAll(after)
    return out


@query
def refresh_manifests(spark, sf_dir):
    """Pages by one manifest, then documents by an edited one, then a broken one, which changes nothing."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    folder = scratch_path(spark, "configs")
    configs = _manifest_configs(spark, sf_dir)
    web = F.exists("sources", lambda s: s["type"] == "static_url")
    read = lambda: manifest.with_defaults(spark.read.schema(manifest.CONFIG).json(folder))
    for number, edited in enumerate((configs.where(web), configs.where(~web), configs.withColumn("bot_name", F.lit("")))):
        edited.write.mode("overwrite").json(folder)
        refresh_manifest(read, lambda: _manifest_landed(spark, sf_dir), store, "timer", number)
    return store.read().select("chunk_id", "source", "type")


@query
def refresh_changed_files(spark, sf_dir):
    """Documents as one file per source, of which some are written anew: only these are opened again."""
    docs = _table(spark, sf_dir, "documents")
    root = scratch_path(spark, "landed")
    store = ChunkStore(spark, scratch_path(spark, "store"))
    seen = ChunkStore(spark, scratch_path(spark, "seen"), SEEN_SCHEMA, "source")

    def read(spark, root, paths):
        rows = spark.read.schema(docs.schema).parquet(root)
        return rows.withColumn("source_file", F.col("_metadata.file_path")).where(F.col("source_file").isin(paths))

    def to_chunks(rows):
        return _whole_texts(rows, F.col("source"), "file", "doc_id")

    land = docs.repartition("source").write.partitionBy("source")
    land.parquet(root)
    refresh_changed(spark, root, read, to_chunks, store, seen)
    news = docs.where(F.col("source") > "src5").withColumn("text", F.concat("text", F.lit(" Second edition.")))
    news = news.repartition("source").write.partitionBy("source").mode("overwrite")
    news.option("partitionOverwriteMode", "dynamic").parquet(root)
    refresh_changed(spark, root, read, to_chunks, store, seen)
    return store.read().select("chunk_id", "source")


def _whole_texts(batch, source, kind, position):
    """Chunk rows of whole texts."""
    return with_content_id(batch.withColumnRenamed("text", "content")).select(
        "chunk_id", "content", source.alias("source"), F.lit(kind).alias("type"), F.lit(0).alias("start_index"),
        source.alias("source_pos"), F.col(position).alias("doc_pos"), F.lit(0).alias("chunk_no"),
    )


@query
def refresh_stream(spark, sf_dir):
    """Documents as a file stream into the store, taken once and then again."""
    schema = _table(spark, sf_dir, "documents").schema
    store = ChunkStore(spark, scratch_path(spark, "store"))
    checkpoint = scratch_path(spark, "progress")

    def to_chunks(batch: DataFrame) -> DataFrame:
        return _whole_texts(batch, F.col("source"), "file", "doc_id")

    for _ in range(2):
        landed = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
        refresh(landed, to_chunks, store, checkpoint).awaitTermination()
    return store.read().select("chunk_id", "source")


@query
def question_stream(spark, sf_dir):
    """Questions as a file stream answered from an index of the distinct documents."""
    schema = _table(spark, sf_dir, "benchmark").schema
    out = scratch_path(spark, "answers")
    asked = spark.readStream.schema(schema).parquet(f"{sf_dir}/benchmark*.parquet")
    asked = asked.select(F.col("item_id").alias("query_id"), "text")
    index = _indexed_documents(spark, sf_dir)
    answer_stream(asked, lambda: index, out, scratch_path(spark, "progress")).awaitTermination()
    return _hit_columns(spark.read.parquet(out))


# --- context and prompts


def _stored_chunks(spark, sf_dir):
    """The documents' chunks with their vectors, written once and read back."""
    chunks = plan.distinct_chunks(plan.file_chunks(_landed_files(spark, sf_dir)))
    store = ChunkStore(
        spark, scratch_path(spark, "store"), embedded_schema(CHUNK_SCHEMA, TERM_VECTOR)
    )
    store.upsert(bag_of_words()(chunks), 0)
    return store.read()


@query
def retrieve_chunks_top5(spark, sf_dir):
    return _hit_columns(answer_hits(_stored_chunks(spark, sf_dir), _questions(spark, sf_dir)))


@query
def build_context(spark, sf_dir):
    return answer_contexts(_stored_chunks(spark, sf_dir), _questions(spark, sf_dir))


@query
def build_prompts(spark, sf_dir):
    """Prompts, every second one with the system prompt of a configuration."""
    stored = F.to_json(F.struct(F.concat(F.lit("Answer as bot "), "query_id", F.lit(".")).alias("system_prompt")))
    asked = _questions(spark, sf_dir).withColumn("config", F.when(F.col("query_id") % 2 == 0, stored).otherwise("{}"))
    asked = manifest.parse_configs(asked, "config").select("query_id", "text", "system_prompt")
    return answer_prompts(_stored_chunks(spark, sf_dir), asked, system=F.col("system_prompt"))


@query
def refresh_two_streams(spark, sf_dir):
    """Documents and pages as two streams, with their own progress, into one store."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    documents = spark.readStream.schema(_table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents*.parquet")
    web = spark.readStream.schema(_table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/pages*.parquet")

    def rows(source, kind, position):
        return lambda batch: _whole_texts(batch, source, kind, position)

    refresh(documents, rows(F.col("source"), "file", "doc_id"), store, scratch_path(spark, "progress")).awaitTermination()
    web = web.withColumnRenamed("html", "text")
    refresh(web, rows(F.col("url"), "url", "page_id"), store, scratch_path(spark, "progress")).awaitTermination()
    return store.read().select("chunk_id", "source", "type")
