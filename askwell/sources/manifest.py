"""The list of sources a corpus is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.functions.text import has_http_scheme

URL_TYPES = ("static_url", "dynamic_json")
FILE_TYPE = "local_file"

SOURCE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
CONFIG = T.StructType(
    [
        T.StructField("bot_name", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("refresh_interval_minutes", T.IntegerType()),
        T.StructField("system_prompt", T.StringType()),
        T.StructField("llm_model", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)

# Defaults of a configuration that leaves these out (fixed values).
DEFAULT_PORT = 8000
DEFAULT_REFRESH_MINUTES = 0
DEFAULT_LLM_MODEL = "llama-3.3-70b-versatile"
DEFAULT_EMBEDDING_MODEL = "all-MiniLM-L6-v2"
# Ports that a configuration may name (fixed values).
PORT_RANGE = (1024, 65535)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file, defaults filled in."""
    return with_defaults(spark.read.schema(CONFIG).option("multiLine", True).json(path))


def parse_configs(texts: DataFrame, column: str) -> DataFrame:
    """The same for configurations that already sit in a text column."""
    keep = [F.col(c) for c in texts.columns if c != column]
    parsed = texts.select(*keep, F.from_json(F.col(column), CONFIG).alias("_c"))
    return with_defaults(parsed.select(*keep, "_c.*"))


def with_defaults(configs: DataFrame) -> DataFrame:
    defaults = {
        "port": DEFAULT_PORT,
        "refresh_interval_minutes": DEFAULT_REFRESH_MINUTES,
        "llm_model": DEFAULT_LLM_MODEL,
        "embedding_model": DEFAULT_EMBEDDING_MODEL,
    }
    return configs.fillna(defaults)


def config_problem(configs: DataFrame) -> Column:
    """What makes a configuration unusable; null if nothing does."""
    name, port, minutes = (
        configs["bot_name"],
        configs["port"],
        configs["refresh_interval_minutes"],
    )
    known = F.forall(
        F.coalesce(configs["sources"], F.array().cast(T.ArrayType(SOURCE))),
        lambda s: s["type"].isin(*URL_TYPES, FILE_TYPE) & s["target"].isNotNull(),
    )
    return (
        F.when(name.isNull() | (name == ""), F.lit("bot_name"))
        .when(~port.between(*PORT_RANGE), F.lit("port"))
        .when(minutes < 0, F.lit("refresh_interval_minutes"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("sources"))
    )


def source_manifest(configs: DataFrame) -> DataFrame:
    """One row per source with its position, which later decides "last wins"."""
    keep = [F.col(c) for c in configs.columns if c != "sources"]
    listed = configs.select(*keep, F.posexplode("sources").alias("source_pos", "_s"))
    return listed.select(*keep, "source_pos", "_s.type", "_s.target", "_s.headers")


def bad_scheme(manifest: DataFrame) -> DataFrame:
    """Web and API sources whose target is not an http(s) address."""
    return manifest.where(F.col("type").isin(*URL_TYPES) & ~has_http_scheme(F.col("target")))


def missing_targets(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """File sources whose target is not in the listing of landed files."""
    files = manifest.where(F.col("type") == FILE_TYPE)
    return files.join(
        listing.select(F.col(path).alias("target")).distinct(), "target", "left_anti"
    )
