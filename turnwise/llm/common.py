"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import turnwise
from turnwise.session import materialize

#: What separates words: the space and the controls tab to carriage return.
GAP = "[ \\x09-\\x0D]+"
LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TO = "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Send this package's functions to the executors by value, so they need no install there."""
    cloudpickle.register_pickle_by_value(turnwise)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, columns stay prunable. The
    folder is the application's own and goes when it exits."""
    return materialize(df)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that columns of any name can't clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text: pieces between gaps, less the empty ones at its edges."""
    whole = F.coalesce(text, F.lit(""))
    return (F.size(F.split(whole, GAP))
            - F.when((whole == "") | whole.rlike("\\A[ \\x09-\\x0D]"), 1).otherwise(0)
            - F.when(whole.rlike("[ \\x09-\\x0D]\\z"), 1).otherwise(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, LOWER_FROM, LOWER_TO)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold that decides what is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def order_key(doc_id: Column, seed: str) -> Column:
    """A shuffled order: hexadecimal digest of seed and id; evenly spread, equal on every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def order_bucket(key: Column) -> Column:
    """The first three digits of an order key: 4,096 even ranges, which cut a hot group into tasks."""
    return F.substring(key, 1, 3)


def stratum(source: Column) -> Column:
    """A join key of a source that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))
