import pytest

from askwell.operators.dedup import last_wins, with_content_id
from askwell.operators.store import ChunkStore, replace_by_id
from askwell.sources.listing import SEEN_SCHEMA


def rows(spark, *pairs):
    table = spark.createDataFrame(list(pairs), "content string, source string, type string, start_index int")
    return with_content_id(table)


def row(content, source):
    return (content, source, "file", 0)


def sources(df):
    return {r.content: r.source for r in df.collect()}


def test_last_wins(spark):
    table = with_content_id(
        spark.createDataFrame([("t", "s1", 0), ("u", "s2", 1), ("t", "s3", 2)], "content string, source string, pos int")
    )
    assert sources(last_wins(table, ["pos"])) == {"t": "s3", "u": "s2"}


def test_one_hot_text_is_reduced_before_the_shuffle(spark):
    table = with_content_id(spark.range(1000).selectExpr("'same' content", "cast(id as string) source", "id"))
    plan = last_wins(table, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert sources(last_wins(table, ["id"])) == {"same": "999"}


def test_replace_by_id(spark):
    store = rows(spark, row("t", "s1"), row("v", "s0"))
    batch = rows(spark, row("t", "s3"), row("n", "s4"))
    assert sources(replace_by_id(store, batch)) == {"t": "s3", "v": "s0", "n": "s4"}


def test_batches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    assert store.upsert(rows(spark, row("t", "s1"), row("v", "s0")), 0)
    assert store.upsert(rows(spark, row("t", "s2")), 1)
    assert store.upsert(rows(spark, row("t", "s3"), row("n", "s4")), 2)
    want = {"t": "s3", "v": "s0", "n": "s4"}
    assert sources(store.read()) == want
    # A replayed batch changes nothing, even with other content.
    assert not store.upsert(rows(spark, row("t", "other")), 2)
    assert sources(store.read()) == want
    # An empty batch writes nothing.
    before = store.batches(complete=False)
    assert not store.upsert(rows(spark, row("x", "s")).limit(0), 3)
    assert store.batches(complete=False) == before
    assert store.upsert(rows(spark, row("v", "s9")), 4)
    assert sources(store.read()) == {**want, "v": "s9"} and store.read().count() == 3


def test_unfinished_batch_is_ignored(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.upsert(rows(spark, row("t", "s1")), 0)
    store.upsert(rows(spark, row("t", "s2")), 1)
    (tmp_path / "store" / "_at=000000000001" / "_writer=main" / "_batch=1" / "_SUCCESS").unlink()
    assert sources(store.read()) == {"t": "s1"}
    assert store.upsert(rows(spark, row("t", "s3")), 1)
    assert sources(store.read()) == {"t": "s3"}


def test_writers_do_not_meet(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.upsert(rows(spark, row("t", "s1")), 5, "a")
    assert store.upsert(rows(spark, row("u", "s1")), 5, "b")
    # A late lower number counts, a replay doesn't.
    assert store.upsert(rows(spark, row("v", "s1")), 2, "a")
    assert not store.upsert(rows(spark, row("x", "s1")), 5, "b")
    assert store.upsert(rows(spark, row("t", "s2")), 0, "a-again")
    # Names and numbers that end alike are others.
    assert store.upsert(rows(spark, row("w", "s1")), 1, "x-main") and store.upsert(rows(spark, row("w", "s2")), 1, "main")
    assert store.upsert(rows(spark, row("y", "s1")), 11, "main")
    want = {"t": "s2", "u": "s1", "v": "s1", "w": "s2", "y": "s1"}
    assert sources(store.read()) == want
    assert not store.upsert(rows(spark, row("x", "s1")), 2, "a") and not store.upsert(rows(spark, row("x", "s1")), 1, "x-main")
    with pytest.raises(ValueError):
        store.upsert(rows(spark, row("x", "s1")), 0, "a/b")


def test_reading_shuffles_keys_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.upsert(rows(spark, row("t", f"s{i}"), row(f"u{i}", "s")), i)
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    shuffled = plan[plan.index("Exchange hashpartitioning") :]
    assert "content" not in shuffled and "max_by" not in plan


def test_tables_of_other_rows(spark, tmp_path):
    seen = ChunkStore(spark, str(tmp_path / "seen"), SEEN_SCHEMA, "source")
    for i, length in enumerate((5, 7)):
        seen.upsert(spark.createDataFrame([("f", i, length)], SEEN_SCHEMA), i)
    assert [tuple(r) for r in seen.read().collect()] == [("f", 1, 7)]


def test_a_single_batch_is_read_without_a_shuffle(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "x", "s", "file", 0), (None, None, "s", "file", 1)], store.schema)
    store.upsert(rows, 0)
    assert sorted(store.read().collect(), key=str) == sorted(rows.collect(), key=str)
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()
