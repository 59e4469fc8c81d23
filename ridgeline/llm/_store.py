"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import threading
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.sources import scratch

_NAME = re.compile(r"ridgeline-[0-9a-f]{32}")
_scopes = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage the way checkpoint() does, and a lost executor takes nothing with it, but
    the columns stay compressed and can be pruned, and the written size lets Spark choose joins.
    """
    spark = df.sparkSession
    path = scratch.scratch(spark)
    schema = df.schema
    if made := getattr(_scopes, "made", None):
        made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _tables(df: DataFrame) -> set[str]:
    return {name for file in df.inputFiles() for name in _NAME.findall(file)}


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later step reads."""
    for file in df.inputFiles()[:1]:
        scratch.delete(df.sparkSession, file.rsplit("/", 1)[0])


def tidy(df: DataFrame) -> DataFrame:
    """Delete the tables that the operator at work has made so far, but for those that df reads; df again."""
    made = _scopes.made[-1]
    used = _tables(df) if made else set()
    for path in made:
        if path.rsplit("/", 1)[1] not in used:
            scratch.delete(df.sparkSession, path)
    made[:] = [path for path in made if path.rsplit("/", 1)[1] in used]
    return df


def tidied(operator):
    """Of the tables that a call of the operator makes, only those that its result reads outlive it."""

    @wraps(operator)
    def run(*args, **named):
        if not hasattr(_scopes, "made"):
            _scopes.made = []
        _scopes.made.append([])
        try:
            out = tidy(operator(*args, **named))
        finally:
            left = _scopes.made.pop()
            if _scopes.made:
                _scopes.made[-1] += left
        return out

    return run


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of df starts with, for columns that join it for a while."""
    prefix = "_"
    while any(name.startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix
