from pyspark.sql import functions as F

from askwell.operators.report import ingest_report
from askwell.plans.ingest import distinct_chunks, ingest, listed

WORDS = "one two three four five six seven eight nine ten"


def test_manifest_decides_what_is_taken_and_who_wins(spark):
    manifest = spark.createDataFrame(
        [(0, "static_url", "https://a"), (1, "dynamic_json", "https://j"), (2, "static_url", "https://b"), (3, "local_file", "f.txt")],
        "source_pos int, type string, target string",
    )
    pages = spark.createDataFrame(
        [(u, f"<p>{WORDS}</p>", 0) for u in ("https://a", "https://b", "https://unlisted", "http://localhost/x")],
        "url string, html string, doc_pos int",
    )
    responses = spark.createDataFrame(
        [("https://j", 200, '{"k": 1}', 0), ("https://j", 500, '{"k": 2}', 1)],
        "url string, status int, body string, doc_pos int",
    )
    files = spark.createDataFrame([("f.txt", "k: 1", 0), ("x.pdf", "k", 1)], "source string, raw string, doc_pos int")
    rows = ingest(
        listed(pages, manifest, "static_url", "url"),
        listed(responses, manifest, "dynamic_json", "url"),
        listed(files, manifest, "local_file", "source"),
    ).cache()
    assert sorted([(r.source, r.type, r.start_index) for r in rows.collect()], key=str) == sorted(
        [("https://a", "url", 0), ("https://b", "url", 0), ("https://j", "json", None), ("f.txt", "file", 0)],
        key=str,
    )
    # The page text of the later source wins, and the file replaces the equal leaf.
    kept = {r.content: (r.source, r.type) for r in distinct_chunks(rows).collect()}
    assert kept == {WORDS: ("https://b", "url"), "k: 1": ("f.txt", "file")}
    report = {r.source: (r.chunks, r.distinct_chunks) for r in ingest_report(rows).collect()}
    assert report["https://a"] == (1, 1) and len(report) == 4
    assert rows.where(F.col("chunk_id") != F.md5("content")).count() == 0


def test_copies_of_a_small_manifest_are_not_broadcast(spark):
    manifest = spark.createDataFrame([(i, "static_url", f"https://{i % 40}") for i in range(50)], "source_pos int, type string, target string")
    pages = spark.createDataFrame([(f"https://{i % 60}", "", i) for i in range(120)], "url string, html string, doc_pos int")
    taken = listed(pages, manifest, "static_url", "url")
    assert {(r.url, r.doc_pos, r.source_pos) for r in taken.collect()} == {
        (f"https://{i % 60}", i, i % 60 + 40 if i % 60 < 10 else i % 60) for i in range(120) if i % 60 < 40
    }
    # The plan that ran: Spark had measured 40 rows before there were 16 of each.
    assert "Broadcast" not in taken._jdf.queryExecution().executedPlan().toString()
