"""JSON to ``path: value`` leaves.

Bodies are read by Python's parser in Arrow batches and walked with a stack of their own, so a body is
read once, however deep it lies, nothing runs while a plan is built, and streams can be flattened too.
Values are written as Python writes them. What the parser refuses (also a nesting beyond its limit of
several thousand levels) has no leaves; ``is_readable`` tells such bodies apart by the same parser.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATOR = " > "
# Leaves of an Arrow batch that a task returns.
LEAVES = 20_000


def read_json(body: str | None) -> tuple[bool, object]:
    """Whether the text is JSON, and its value."""
    try:
        return True, json.loads(body or "")
    except (ValueError, RecursionError):
        return False, None


def leaves(node: object) -> Iterator[tuple[str, str]]:
    """``(path, value)`` of every leaf; null and blank ones are left out.

    A list's elements have its own path. An empty path above leaves a key as it is.
    """
    todo = [("", node)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{path}{SEPARATOR}{key}" if path else key, child) for key, child in node.items()]
        elif isinstance(node, list):
            todo += [(path, child) for child in node]
        elif node is not None and (text := str(node).strip()):
            yield path, text


def _encodable(texts: list[str]) -> list[str]:
    """Escapes of half a surrogate pair have no place in UTF-8."""
    return [t.encode("utf-8", "replace").decode() for t in texts]


def _flatten(body: str, keep: list[str]):
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            paths: list[str] = []
            texts: list[str] = []

            def found() -> pa.RecordBatch:
                kept = batch.select(keep).take(pa.array(rows, pa.int64()))
                try:
                    own = [pa.array(c, pa.string()) for c in (paths, texts)]
                except UnicodeEncodeError:
                    own = [pa.array(_encodable(c), pa.string()) for c in (paths, texts)]
                for column in (rows, paths, texts):
                    column.clear()
                return pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*keep, "path", "content"])

            for i, value in enumerate(batch.column(body)):
                for path, text in leaves(read_json(value.as_py())[1]):
                    rows.append(i)
                    paths.append(path)
                    texts.append(f"{path}: {text}")
                    if len(rows) >= LEAVES:
                        yield found()
            yield found()

    return flatten


def all_leaves(df: DataFrame, body: str) -> DataFrame:
    """Replace a JSON text column by one row per leaf: ``path``, ``content``."""
    keep = [c for c in df.columns if c != body]
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
    return df.mapInArrow(_flatten(body, keep), schema)


@F.pandas_udf(T.BooleanType())
def _readable(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: read_json(body)[0])


def is_readable(body: Column) -> Column:
    """Whether a body is JSON."""
    return F.coalesce(_readable(body), F.lit(False))
