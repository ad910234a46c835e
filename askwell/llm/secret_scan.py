"""Secret scan: a random forest removes the false positives among candidate strings.

Candidates are private keys in armour, values of six characters and more that are assigned to a name for
secrets (quoted, after an equals sign, or with a digit), and all other runs of at least ten key characters
with a digit among them. Each is described by
its length, its characters (kinds, changes of kind, distinct ones), its character transitions (mean
log probability of its pairs in words of a public vocabulary), its dictionary coverage (share of its
characters in runs of letters that are words), whether it stands in a path or address, and the words
before it. A forest trained on labelled findings scores them.

Labelled findings are given, or made by rules that leave the unclear ones out: fixed key formats and
long values of several kinds of characters assigned to a password-like name are secrets; numbers, parts of
addresses and paths, dictionary words and values called a hash or an id are not. Short or wordlike values
with such a name are left to the forest. At most ``SAMPLE`` labelled findings, in the order of a
hash, train the forest (a documented bound); everything else covers all texts whole.

All of it is DataFrame and SQL functions and Spark's own forest. Texts with candidates are split at them;
a text's findings are ordered by a window over that text alone, and texts are put together again with
the secrets replaced. The vocabulary's words (under 50,000) are the only broadcast.

Defined results: null and empty texts have no findings; repeated rows have the same findings (once per
distinct text of a doc_id); without labelled findings of both kinds the rules alone decide; no rows
give no rows; other columns are ignored, or kept as they are by ``redacted``.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import documents, written

SAMPLE = 20_000
TREES, DEPTH, SEED = 24, 6, 11
CUTOFF = 0.5
REPLACEMENT = "[SECRET]"
# Public key formats, and names that secrets or harmless values go by.
KEY_FORMAT = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20}|-----BEGIN [\s\S]*)$"
NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)(?i:s?)"
HARMLESS_NAME = r"(?i)\b(hash|sha-?[0-9]*|md5|commit|checksum|digest|uuid|guid|isbn|phone|tel|card|order|invoice|id|version|rev)\b"

# A private key: to its end, or as far as it looks like one.
ARMOUR = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[\s\S]{0,20000}?-----END [A-Z ]{0,30}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n\\]*)"
# A name, what assigns to it, and an opening quote: not part of the finding.
HEAD = NAME + r"[\x22\x27]?[ \t]{0,3}(?:=>|:=|[:=])[ \t]{0,3}[\x22\x27]?"
# Values that begin like a reference to a variable aren't values.
PLAIN = r"[^\s\x22\x27<>,;(){}\[\]$%*&]"
VALUE = (
    rf"{NAME}[\x22\x27]?[ \t]{{0,3}}(?:(?:=>|:=|[:=])[ \t]{{0,3}}(?:\x22[^\x22\n$<%{{][^\x22\n]{{5,}}\x22|\x27[^\x27\n$<%{{][^\x27\n]{{5,}}\x27)"
    rf"|=[ \t]{{0,3}}{PLAIN}{{6,}}|:[ \t]{{0,3}}(?={PLAIN}*[0-9]){PLAIN}{{6,}})"
)
# A run isn't the name that something is assigned to.
RUN = rf"(?<![A-Za-z0-9+/_\-])(?![A-Za-z0-9_\-]*{NAME}[\x22\x27]?[ \t]{{0,3}}[:=])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{10,}}={{0,2}}"
CANDIDATE = f"{ARMOUR}|{VALUE}|{RUN}"

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "transitions", "coverage", "is_hex", "only_digits",
    "in_path", "in_address", "secret_name", "assigned", "quoted", "harmless_name", "key_prefix",
)


def vocabulary_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of four letters or more of a public vocabulary file (its ``</w>`` entries), one column: word."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    words = sorted({e[:-4] for e in entries if e.endswith("</w>") and len(e) >= 8 and e[:-4].isascii() and e[:-4].isalpha()})
    return spark.createDataFrame([(w,) for w in words], "word string")


def transition_costs(words: DataFrame) -> list[float]:
    """Log probability of each pair of characters in the words; place 37 * first + second, 0 for others."""
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}  # 26 * 26 at most
    size = len(ALPHABET) + 1
    places = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = [[1.0] * size for _ in range(size)]
    for pair, n in found.items():
        counts[places.get(pair[0], 0)][places.get(pair[1], 0)] += n
    import math

    return [math.log(c / sum(row)) for row in counts for c in row]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), k, start, finding, before and after (the text around it, also other findings)."""
    plain = documents(docs, "doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    parts = plain.select(
        "doc_id", F.xxhash64("text").alias("mark"),
        F.expr(f"regexp_extract_all(text, r'{CANDIDATE}', 0)").alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"),
    ).dropDuplicates(["doc_id", "mark"])
    one = F.expr(
        f"transform(found, (f, i) -> named_struct('k', i, 'whole', f, 'head', {head_of('f')}, 'gap', length(gaps[i]),"
        " 'lead', right(concat(if(i > 0, found[i - 1], ''), gaps[i]), 48), 'rest', left(gaps[i + 1], 8)))"
    )
    rows = parts.select("doc_id", "mark", F.explode(one).alias("c")).select("doc_id", "mark", "c.*")
    along = W.partitionBy("doc_id", "mark").orderBy("k")
    start = F.sum(F.col("gap") + F.length("whole")).over(along) - F.length("whole") + F.length("head")
    tail = F.expr(tail_of("whole", "head"))
    return rows.select(
        "doc_id", "mark", "k", start.alias("start"),
        F.expr(f"substring(whole, length(head) + 1, length(whole) - length(head) - length({tail_of('whole', 'head')}))").alias("finding"),
        F.concat("lead", "head").alias("before"), F.concat(tail, "rest").alias("after"),
    )


def head_of(whole: str) -> str:
    """What of a match stands before the finding, as SQL."""
    return f"regexp_extract({whole}, r'^{HEAD}', 0)"


def tail_of(whole: str, head: str) -> str:
    """The closing quote of a match, as SQL."""
    return rf"if({head} rlike r'[\x22\x27]$', right({whole}, 1), '')"


def described(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with their features."""
    costs = ", ".join(f"{c:.4f}D" for c in transition_costs(words))
    size = len(ALPHABET) + 1
    step = f"element_at(array({costs}), {size} * locate(substring(low, i, 1), '{ALPHABET}') + locate(substring(low, i + 1, 1), '{ALPHABET}') + 1)"
    n = F.length("finding").cast("double")
    share = lambda pattern: F.regexp_count("finding", F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    # Coverage is looked up once per distinct run of letters.
    runs = rows.select("finding").distinct().select("finding", F.explode(F.expr("regexp_extract_all(lower(finding), '[a-z]{4,}', 0)")).alias("word"))
    covered = runs.join(F.broadcast(words), "word").groupBy("finding").agg(F.sum(F.length("word")).alias("covered"))
    out = rows.join(covered, "finding", "left").withColumn("low", F.lower("finding"))
    return out.select(
        "doc_id", "mark", "k", "start", "finding", "before",
        n.alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"), share("[^A-Za-z0-9]").alias("others"),
        share("(?<=[0-9])[^0-9]|(?<=[A-Z])[^A-Z]|(?<=[a-z])[^a-z]").alias("changes"),
        (F.size(F.array_distinct(F.split("finding", ""))) / n).alias("distinct"),
        (F.expr(f"aggregate(sequence(1, length(low) - 1), 0D, (a, i) -> a + {step})") / (n - 1)).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        flag(F.col("finding").rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("is_hex"), flag(F.col("finding").rlike("^[0-9-]+$")).alias("only_digits"),
        flag(F.col("finding").contains("/") | F.col("before").rlike(r"[/\\]$") | F.col("after").rlike(r"^(\.[A-Za-z]{2,4}\b|/)")).alias("in_path"),
        flag(F.col("before").rlike(r"(://|www\.|@)\S*$") | F.col("after").startswith("@")).alias("in_address"),
        flag(F.col("before").rlike(NAME + r"\W{0,6}$")).alias("secret_name"), flag(F.col("before").rlike(r"""[=:]\s*["']?$""")).alias("assigned"),
        flag(F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")).alias("quoted"), flag(F.col("before").rlike(HARMLESS_NAME + r"\W{0,6}$")).alias("harmless_name"),
        flag(F.col("finding").rlike(KEY_FORMAT)).alias("key_prefix"),
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Label by rule: 1 secret, 0 harmless, null unclear."""
    mixed_kinds = (F.col("digits") > 0) & (F.col("digits") < 1)
    secret = (F.col("key_prefix") == 1) | ((F.col("secret_name") == 1) & (F.col("assigned") == 1) & mixed_kinds & (F.col("length") >= 12))
    named = (F.col("secret_name") == 1) & (F.col("assigned") == 1)
    harmless = (F.col("only_digits") == 1) | (F.col("in_path") == 1) | (F.col("in_address") == 1) | (F.col("coverage") > 0.6) | (F.col("harmless_name") == 1)
    harmless = harmless & ~named
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def trained(findings: DataFrame, sample: int = SAMPLE):
    """A forest over labelled findings, or None if they aren't of both kinds."""
    given = findings.where("label IS NOT NULL").select(*FEATURES, "label", F.xxhash64("finding", "doc_id", "k").alias("order"))
    few = written(given.orderBy("order", *FEATURES).limit(sample), "labelled-findings")
    if few.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(few))


def findings(docs: DataFrame, vocabulary: str, model=None) -> DataFrame:
    """doc_id, mark, k, start, finding, score, secret, for every candidate of the texts."""
    words = vocabulary_words(docs.sparkSession, vocabulary)
    rows = written(labelled(described(candidates(docs), words)), "findings")
    model = model or trained(rows)
    keys = ("doc_id", "mark", "k", "start", "finding")
    if model is None:
        score = F.coalesce("label", F.lit(0.0))
        return rows.select(*keys, score.alias("score"), (score >= CUTOFF).alias("secret"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*keys, score.alias("score"), (score >= CUTOFF).alias("secret"))


def redacted(docs: DataFrame, vocabulary: str, model=None) -> DataFrame:
    """The documents with their secrets replaced; no document is dropped."""
    secrets = findings(docs, vocabulary, model).where("secret").groupBy("doc_id", "mark").agg(F.collect_set("k").alias("_ks"))
    secrets = secrets.select(F.col("doc_id").alias("_sid"), F.col("mark").alias("_smark"), "_ks")
    # The documents' own columns travel as one, so that none clashes with those used here.
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    # Only texts with candidates meet the findings; all others pass through.
    has = F.coalesce(F.col("_row.text").rlike(CANDIDATE), F.lit(False))
    open_ = kept.where(has).withColumn("_mark", F.xxhash64("_row.text"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_sid")) & (F.col("_mark") == F.col("_smark"))
    joined = open_.join(secrets, same, "left")
    joined = joined.withColumn("_found", F.expr(f"regexp_extract_all(_row.text, r'{CANDIDATE}', 0)")).withColumn("_gaps", F.split("_row.text", CANDIDATE, -1))
    covered = f"concat({head_of('_found[i]')}, '{REPLACEMENT}', {tail_of('_found[i]', head_of('_found[i]'))})"
    put = f"array_join(transform(_gaps, (g, i) -> concat(g, CASE WHEN i >= size(_found) THEN '' WHEN array_contains(_ks, i) THEN {covered} ELSE _found[i] END)), '')"
    text = F.expr(f"CASE WHEN _ks IS NULL THEN _row.text ELSE {put} END")
    columns = [(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return kept.where(~has).select(*(F.col(f"_row.`{c}`") for c in docs.columns)).union(joined.select(*columns))
