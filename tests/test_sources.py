import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askwell.functions.text import clean_question, has_http_scheme, is_safe_url, strip, url_host
from askwell.operators.flatten import all_leaves, is_readable
from askwell.sources import files, manifest, pages, responses


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "url, safe",
    [
        ("http://LOCALHOST/", False),
        ("http://127.0.0.1:8/", False),
        ("http://0.0.0.0", False),
        ("http://[::1]/", False),
        ("no-host", False),
        ("", False),
        ("http://10.0.0.1/", True),
        ("http://127.0.0.2/", True),
        ("https://a.example.com/", True),
    ],
)
def test_safe_url(spark, url, safe):
    assert one(spark, is_safe_url, url) is safe


def test_host(spark):
    assert one(spark, url_host, "https://u:p@A.Example.com:81/x?y#z") == "a.example.com"
    assert one(spark, url_host, "http://[FE80::1]:8/") == "fe80::1"
    assert one(spark, url_host, "mailto:x") is None


@pytest.mark.parametrize("url, ok", [("ftp://a", False), ("HTTP://a", False), ("https://a", True)])
def test_scheme(spark, url, ok):
    assert one(spark, has_http_scheme, url) is ok


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a" * 999 + "\nbb", "a" * 999),
        ("a\nb", "ab"),
        ("　 a\x7f\x00 b  ", "a b"),
        (" " * 1000 + "late", ""),
    ],
)
def test_clean_question(spark, raw, clean):
    assert one(spark, clean_question, raw) == clean


def test_strip_is_python_strip(spark):
    for text in ["\x1c\x85 a  b \n", "​keep​", "", " \t"]:
        assert one(spark, strip, text) == text.strip()


@pytest.mark.parametrize("target, route", [("a.pdf", "pdf"), ("a.PDF", "text"), ("a.txt", "text")])
def test_suffix_route(spark, target, route):
    assert one(spark, files.suffix_route, target) == route


@pytest.mark.parametrize(
    "status, route", [(200, "ok"), (401, "auth"), (403, "auth"), (404, "error"), (500, "error")]
)
def test_response_route(spark, status, route):
    assert one(spark, responses.route, status, "int") == route


NUMBERS = [1.0, 0.1, -2.5, 1e7, 123456789.25, 1e15, 1e16, 1e20, 1e100, 1.5e-4, 1e-5, -2.5e-10, 0.001, 0.0]


def test_numbers_are_python_text(spark):
    rows = spark.createDataFrame([(i, json.dumps({"x": x})) for i, x in enumerate(NUMBERS)], "id int, body string")
    assert {r.id: r.content for r in all_leaves(rows, "body").collect()} == {i: f"x: {x}" for i, x in enumerate(NUMBERS)}


# Bodies with the leaves that are expected of them.
LEAVES = {
    '{"b":{"c":[1,{"d":"z"}]},"a":"y"}': ["b > c: 1", "b > c > d: z", "a: y"],
    '"x"': [": x"],
    '{"a":null,"b":"  ","c":[],"d":true,"e":1.0}': ["d: True", "e: 1.0"],
    '{"":{"k":1}}': ["k: 1"],
    '{"p":{"":"v"}}': ["p > : v"],
    '{"a":1,"a":2,"f":1e20,"g":1e-7,"h":123456789012345678901,"i":0.1234567890123456789,"j":1.10}': [
        "a: 2", "f: 1e+20", "g: 1e-07", "h: 123456789012345678901", "i: 0.12345678901234568", "j: 1.1",
    ],
    "[[[]],[{}], {}]": [],
    "[0]": [": 0"],
    '{"a":{"b":[[1,[2,{"c":[false,"\\"{[ x"]}]]]}}': ["a > b: 1", "a > b: 2", "a > b > c: False", 'a > b > c: "{[ x'],
    "[" * 30 + "7" + "]" * 30: [": 7"],
}
EMPTY = ["{}", "[]", "0", "0.0", "false", '""', "null", "bad", ""]


def test_leaf_documents(spark):
    bodies = [*LEAVES, *EMPTY]
    rows = [(i, "u", 200, b) for i, b in enumerate(bodies)] + [(99, "u", 404, '{"a":1}')]
    landed = spark.createDataFrame(rows, "id int, url string, status int, body string")
    got = sorted((r.id, r.content) for r in responses.leaf_documents(landed).collect())
    want = [(i, x) for i, leaves in enumerate(LEAVES.values()) for x in leaves]
    assert got == sorted(want)


def test_no_leaf_is_lost_however_deep(spark):
    deep = '{"k":' * 200 + "7" + "}" * 200
    rows = [(1, '{"a":{"b":[1,{"c":" x "}]},"c":2}'), (2, "[" * 300), (3, "{" * 300 + "}" * 299), (4, deep), (5, "[" * 900 + "8" + "]" * 900), (6, None)]
    rows += [(7, "[" * 1_000_000), (8, json.dumps(list(range(50_000)))), (9, '"half \\ud800 pair"'), (10, "1" * 5000)]
    landed = spark.createDataFrame([(i, "k", b) for i, b in rows], "id int, path_ string, body string")
    got = [(r.id, r.content) for r in all_leaves(landed, "body").collect()]
    want = {(1, "a > b: 1"), (1, "a > b > c: x"), (1, "c: 2"), (4, " > ".join(["k"] * 200) + ": 7"), (5, ": 8"), (9, ": half ? pair")}
    assert len(got) == len(want) + 50_000
    assert set(got) == want | {(8, f": {i}") for i in range(50_000)}
    readable = {r.id for r in landed.where(is_readable(F.col("body"))).collect()}
    assert readable == {1, 4, 5, 8, 9}


def test_empty_payloads_and_blank_leaves(spark):
    rows = spark.createDataFrame([("u", 200, b) for b in EMPTY] + [("u", 200, '{"a":" \\n","b":null,"c":[[],{}]}')], "url string, status int, body string")
    assert responses.leaf_documents(rows).count() == 0


def test_leaves_of_a_stream(spark, tmp_path):
    schema = "id int, body string"
    spark.createDataFrame([(1, '{"a":[1,2]}'), (2, "{")], schema).write.parquet(str(tmp_path / "in"))
    stream = all_leaves(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "body")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a: 1"), (1, "a: 2")}


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("http://my_host.example.com/a", "my_host.example.com"), ("http://a.example.com/q?x=a|b", "a.example.com"), ("http://a b.example.com/{id}", "a b.example.com"),
        ("http://münchen.de/x", "münchen.de"), ("http://user:p@w@Host.example.com:80/x@y", "host.example.com"), ("http://[::1]:8/", "::1"), ("no-host", None), ("http://", None),
        ("https://u@[FE80::2]/", "fe80::2"), ("http://host?q", "host"), ("ftp://files.example.org", "files.example.org"),
    ],
)
def test_host_is_read_from_the_text(spark, url, host):
    assert one(spark, url_host, url) == host


def test_flatten_is_one_narrow_pass_and_runs_nothing_early(spark, monkeypatch):
    rows = spark.createDataFrame([('{"a":1}',)], "body string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    plan = all_leaves(rows, "body")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("MapInArrow") == 1 and jobs() == before


def test_page_text(spark):
    words = "one two three four five six seven eight nine ten"
    html = (
        '<html><head><title>t</title></head><body><!-- no --><script>var t="</p>";</script>'
        f"<p>{words}</p><p>too short</p><div>{words}&amp;&amp;lt; <b>x</b></div></body></html>"
    )
    assert one(spark, pages.page_text, html) == f"{words}\n\n{words}&&lt; x"


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<!-- no --> b<!---->c", "a bc"),
        ("a<P CLASS='x'>b</P>c<br/>d", "a\nb\nc\nd"),
        ("<header>h</header><head><title>t</title></head>x", "\nh\nx"),
        ("<script>if (a<b) { x = '</p>' }</script>y<STYLE>p{}</style >z", "yz"),
        ("<!-- never closed <p>text</p> more", "\ntext\n more"),
        ("x <!-- never closed", "x "),
        ("x <!-- odd > y <b>z</b>", "x  y z"),
        ("<p>one</p><script>var a = 1; if (a < 2) {} <p>two</p>", "\none\n\ntwo\n"),
        ("<p>one</p><style>p { color: red }", "\none\n"),
        ("<head><title>t</title><body><p>one</p>", "\none\n"),
        ("<script>a()<div>x</div><script>b()</script>y", "y"),
        ("5 < 6 and <i>it</i>alic <", "5 italic <"),
        ("<scripted>s</scripted><head_x>h</head_x>", "sh"),
        ("< b > c", " c"),
        ("no tags", "no tags"),
        ("", ""),
    ],
)
def test_visible_text(html, text):
    assert pages.visible_text(html) == text


def test_malformed_pages_take_linear_time():
    began = time.perf_counter()
    for unit in ("<", "<!-- ", "<script>", "<script> <p>", "</", "<!-- > "):
        pages.visible_text(unit * 100_000 + ">")
        pages.visible_text(unit * 100_000)
    assert time.perf_counter() - began < 20


def test_pages_without_html(spark):
    assert one(spark, pages.page_text, None) is None and one(spark, pages.page_text, "") == ""


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("one\r\ntwo\rthrée".encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "c.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    landed = files.read_files(spark, str(tmp_path / "in"))
    docs = {r.source.rsplit("/", 1)[1]: r.text for r in files.file_documents(landed).collect()}
    assert docs.pop("a.txt") == "one\ntwo\nthrée" and not any(docs.values())
    reason = files.reject_reason(F.col("source"), F.col("raw"))
    bad = {r.source[-5:]: r.why for r in landed.select("source", reason.alias("why")).collect() if r.why}
    assert bad == {"b.pdf": "pdf", "c.txt": "not utf-8"}


def test_manifest(spark, tmp_path):
    config = {
        "bot_name": "b",
        "sources": [
            {"type": "static_url", "target": "https://a"},
            {"type": "dynamic_json", "target": "ftp://x", "headers": {"K": "v"}},
            {"type": "local_file", "target": "here.txt"},
            {"type": "local_file", "target": "gone.txt"},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    configs = manifest.read_configs(spark, str(tmp_path / "c.json"))
    assert configs.select(manifest.config_problem(configs)).first()[0] is None
    listed = manifest.source_manifest(configs)
    rows = {r.source_pos: r for r in listed.collect()}
    assert [rows[i].target for i in range(4)] == ["https://a", "ftp://x", "here.txt", "gone.txt"]
    assert rows[0].port == 8000 and rows[0].refresh_interval_minutes == 0
    assert rows[1].headers == {"K": "v"}
    assert [r.target for r in manifest.bad_scheme(listed).collect()] == ["ftp://x"]
    listing = spark.createDataFrame([("here.txt",)], "path string")
    assert [r.target for r in manifest.missing_targets(listed, listing).collect()] == ["gone.txt"]


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"bot_name": ""}, "bot_name"),
        ({"port": 80}, "port"),
        ({"refresh_interval_minutes": -1}, "refresh_interval_minutes"),
        ({"sources": [{"type": "ftp", "target": "x"}]}, "sources"),
        ({"sources": []}, None),
    ],
)
def test_config_problem(spark, change, problem):
    text = json.dumps({"bot_name": "b", **change})
    configs = manifest.parse_configs(spark.createDataFrame([(text,)], "t string"), "t")
    assert configs.select(manifest.config_problem(configs)).first()[0] == problem


def test_a_worker_gets_a_bounded_number_of_bytes(spark):
    def sizes(batches):
        yield from (pd.DataFrame({"n": [len(b)]}) for b in batches)

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert max(r.n for r in rows.mapInPandas(sizes, "n long").collect()) < 1000
