import random
import time

import brute
import pytest

from askwell.operators.chunk import chunk_texts, split_text

FIXED = [
    "x" * 1300 + " y " + "z" * 499 + "\n" + "w" * 500,
    "   \n ",
    "",
    "p q\n\n" * 300,
    "a b\n\n\n\nc " * 200,
    "\n" * 1600,
    "q" * 500,
    "q" * 501,
    "q" * 499 + "\n\n" + "r" * 501,
    "k" * 10 + " " + "m" * 498 + " " + "n" * 3,
    "same line here\n" * 200,
    "\x1c tab end　 " * 60,
    "𝒳é " * 700,
]


def random_texts(count, longest, seed):
    rnd = random.Random(seed)
    mixes = [(8, 2, 1, 1), (50, 2, 1, 1), (400, 1, 1, 1), (1, 1, 1, 1), (30, 10, 0, 0), (3, 0, 3, 3)]
    for _ in range(count):
        weights = rnd.choice(mixes)
        yield "".join(rnd.choices(["aé", " ", "\n", "𝒳"], weights, k=rnd.randint(1, longest)))


def got_and_expected(spark, texts, size, overlap):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {i: {} for i in range(len(texts))}
    for row in chunk_texts(rows, "text", size, overlap).collect():
        got[row.id][row.chunk_no] = (row.content, row.start_index)
    for i, text in enumerate(texts):
        want = brute.chunks(text, size, overlap)
        places = brute.offsets(want, text, overlap)
        yield text, [got[i][n] for n in range(len(got[i]))], list(zip(want, places))


@pytest.mark.parametrize(
    "size, overlap, longest", [(500, 100, 4000), (40, 10, 500), (30, 20, 300), (25, 0, 300), (7, 6, 90)]
)
def test_same_as_brute_force(spark, size, overlap, longest):
    texts = FIXED + list(random_texts(120, longest, size))
    for text, got, want in got_and_expected(spark, texts, size, overlap):
        assert got == want, text[:80]


def test_chunks_cover_the_text(spark):
    texts = FIXED + list(random_texts(40, 4000, 1))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = {}
    for row in chunk_texts(rows).collect():
        assert len(row.content) <= 500
        assert row.content in texts[row.id] and row.content == row.content.strip() != ""
        seen.setdefault(row.id, set()).update(row.content)
    for i, text in enumerate(texts):
        assert {c for c in text if not c.isspace()} <= seen.get(i, set())


def test_null_and_blank_give_nothing_and_columns_stay(spark):
    rows = spark.createDataFrame([(1, None, "s"), (2, " \n", "s"), (3, " a ", "s")], "id int, text string, source string")
    assert [tuple(r) for r in chunk_texts(rows).collect()] == [(3, "s", 0, "a", 1)]


def test_partitioning_does_not_matter(spark):
    rows = spark.createDataFrame(list(enumerate(random_texts(50, 3000, 9))), "id int, text string")
    one = sorted(map(tuple, chunk_texts(rows.coalesce(1)).collect()))
    many = sorted(map(tuple, chunk_texts(rows.repartition(7)).collect()))
    assert one == many


def test_no_shuffle_and_texts_are_cut_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "id int, text string").write.parquet(f"{tmp_path}/t")
    plan = chunk_texts(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_long_texts_take_linear_time():
    def seconds(text):
        began = time.perf_counter()
        assert sum(1 for _ in split_text(text)) > len(text) // 500
        return time.perf_counter() - began

    for unit in ("word and line\n", "word ", "x", "a b\n\n", "repeated line of some length\n"):
        small, large = (seconds(unit * (n // len(unit))) for n in (1_000_000, 4_000_000))
        assert large < 8 * small + 0.5


def test_overlap_must_be_smaller_than_size(spark):
    with pytest.raises(ValueError):
        chunk_texts(spark.createDataFrame([("a",)], "text string"), "text", 10, 10)
