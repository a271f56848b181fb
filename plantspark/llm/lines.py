"""Line de-duplication: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.llm.common import columns, keep_columns, let, lower_ascii

#: A common line is joined to its documents in this many parts, so one that all documents hold is no single task's.
PARTS = 16
TRIM = r" \t\n\u000b\f\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.call_function("btrim", line, F.lit(TRIM.encode().decode("unicode_escape"))))


def dropped_positions(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``doc_id``, hash of the text and the line positions (from 0) that go.

    A key is stood for by two independent 64-bit hashes. Counting is two aggregates, each combined before
    its shuffle, so a line that every document holds costs a row per task. For the join back, the documents of a line
    are dealt into ``PARTS`` parts, each of which meets its own row of the common line.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = (
        lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    common = (
        keyed.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "last_doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    )
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(PARTS)))
    gone = dealt.join(common, ["h1", "h2", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def drop_common_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """All columns of ``docs`` with ``text`` shortened, then ``n_lines`` and ``n_dropped``.

    A line whose key (blanks stripped at both ends, A-Z lower-cased) has at least ``min_chars`` code points and is
    found in at least ``min_docs`` documents stays only in the largest ``doc_id`` that holds it. Null and empty
    texts are one empty line; a null ``doc_id`` counts as one document, smaller than all others; rows with the
    same ``doc_id`` are one document. Columns named as a result are replaced, further ones kept.
    """
    own = columns(docs, "doc_id", "text")
    source = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = dropped_positions(source, min_docs, min_chars)
    rest = keep_columns(docs, ["doc_id", "text", "n_lines", "n_dropped"])
    whole = docs.select(
        F.col("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in rest],
    ).withColumn("_llm_hash", F.xxhash64("text"))
    gone = gone.select(F.col("doc_id").alias("_llm_doc"), F.col("text_hash").alias("_llm_text"), F.col("positions").alias("_llm_gone"))
    both = whole.join(
        gone, F.col("doc_id").eqNullSafe(F.col("_llm_doc")) & (F.col("_llm_hash") == F.col("_llm_text")), "left"
    )

    def without(gone: Column) -> Column:
        def shorten(lines: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

        return let(F.split("text", "\n", -1), shorten)

    return both.select(
        *[
            F.when(F.col("_llm_gone").isNull(), F.col("text")).otherwise(without(F.col("_llm_gone"))).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in docs.columns
            if c in ("doc_id", "text", *rest)
        ],
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_llm_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
