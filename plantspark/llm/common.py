"""Small helpers of the corpus operators: columns, words, hashes, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The same for Python strings.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Further columns never matter, even under a name that repeats or differs only in case."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    for i, c in enumerate(df.columns):
        at.setdefault(c.lower(), i)
    own = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def keep_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` that are not among ``names``, in either case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 0), F.array().cast("array<string>"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; a null identifier is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors see.

    Only a session on one machine that names none (tests) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plantspark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read from there, column by column."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
