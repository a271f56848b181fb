"""The corpus pipeline: documents through language, lines, near-duplicates, benchmark copies, to the mixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.llm import decontam, langid, lines, mixing, neardup
from plantspark.llm.common import cut, fold, keep_columns, table

#: The near-duplicate and the order stage have no SQL; the tests compare the rows with a plain Python version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that has half of their letters, go."""
    return langid.keep_identified(docs, langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0)))


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the last of them only; the length of the text follows."""
    shorter = lines.drop_common_lines(docs).drop("n_lines", "n_dropped")
    return shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over five-word shingles stays."""
    return neardup.keep_one(docs, percent=80)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and position (columns of these names are replaced), in the order to be read."""
    own = keep_columns(docs, ["block", "slot", "position"])
    rest = F.struct(F.lit(0).alias("_llm"), *[c for c in own if c not in ("doc_id", "source")])
    placed = mixing.mix(docs.select("doc_id", "source", rest.alias("_llm_rest")), carry=("_llm_rest",))
    whole = placed.select(*[c if c in ("doc_id", "source") else f"_llm_rest.{c}" for c in own], "block", "slot", "position")
    return whole.repartitionByRange("position").sortWithinPartitions("position")


STAGES = [
    ("language", language),
    ("common_lines", common_lines),
    ("near_copies", near_copies),
    ("benchmark_copies", benchmark_copies),
    ("mixed", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
