"""Row flags: append, filter, one-hot, vocabulary, output contract."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.schema import ALLOWED_METADATA_KEYS, FORBIDDEN_COLUMNS, QUALITY_FLAGS

FLAGS = "quality_flags"


def no_flags() -> Column:
    return F.array().cast("array<string>")


def add_flag(flags: Column, predicate: Column, flag: str) -> Column:
    """``flags`` with ``flag`` added where the predicate holds (null counts as false)."""
    return F.when(F.coalesce(predicate, F.lit(False)), F.array_union(flags, F.array(F.lit(flag)))).otherwise(flags)


def with_flags(df: DataFrame, rules: dict[str, Column], flags: str = FLAGS) -> DataFrame:
    """Append every flag whose predicate holds, in the order of ``rules``."""
    out = F.coalesce(F.col(flags), no_flags()) if flags in df.columns else no_flags()
    for name, pred in rules.items():
        out = add_flag(out, pred, name)
    return df.withColumn(flags, out)


def drop_flagged(df: DataFrame, flags: str = FLAGS) -> DataFrame:
    return df.where(F.size(flags) == 0)


def one_hot(df: DataFrame, vocabulary: Sequence[str] = tuple(QUALITY_FLAGS), flags: str = FLAGS, prefix: str = "flag_") -> DataFrame:
    return df.withColumns({f"{prefix}{f.lower()}": F.array_contains(flags, f).cast("int") for f in vocabulary})


def unknown_flags(df: DataFrame, vocabulary: Sequence[str] = tuple(QUALITY_FLAGS), flags: str = FLAGS) -> DataFrame:
    """Flags in use that the vocabulary does not know, with their row counts."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return (
        df.select(F.explode(F.array_except(flags, vocab)).alias("flag"))
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def vocabulary_diff(flags: Column, vocabulary: Iterable[str]) -> dict[str, Column]:
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return {"unknown": F.array_except(flags, vocab), "unused": F.array_except(vocab, flags)}


def sanitise_columns(df: DataFrame, forbidden: Sequence[str] = tuple(FORBIDDEN_COLUMNS)) -> DataFrame:
    return df.drop(*forbidden)


def sanitise_metadata(meta: Column, allowed: Sequence[str] = tuple(ALLOWED_METADATA_KEYS)) -> Column:
    return F.map_filter(meta, lambda k, _: k.isin(list(allowed)))


def flags_to_json(df: DataFrame, flags: str = FLAGS) -> DataFrame:
    return df.withColumn(flags, F.to_json(flags))


def flags_from_json(df: DataFrame, flags: str = FLAGS) -> DataFrame:
    return df.withColumn(flags, F.from_json(flags, "array<string>"))
