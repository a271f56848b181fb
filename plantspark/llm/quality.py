"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.llm.common import BLANKS, columns, let, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the be to of and that have with this from for was are is in it on as at by
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als
le la les de des du et un une en que qui dans est pour par sur pas avec au
el los las del y una con por su se lo para no al es o
""".split()

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if the ratio lies between the bounds, both included; None is no bound."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


#: ratio: SQL over the counts that ``counts`` makes; a null ratio passes.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2, 20),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("exclamations_per_word", "n_exclamations / n_words", None, 0.5),
    Rule("stop_word_share", "n_stop_words / n_words", 0.01, None),
    Rule("letter_word_share", "n_letter_words / n_words", 0.6, None),
    Rule("repeated_line_share", "n_dup_lines / n_lines", None, 0.5),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the array; linear but for a sort of windows.

    Windows are compared by a 64-bit hash of the eight words, within one text only.
    """
    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeats(ordered: Column) -> Column:
        twice = F.transform(
            ordered,
            lambda x, k: F.when(
                F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        )
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(let(ordered, repeats), covered)
        )

    return let(windows, count)


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every whole text; a null text has no words and one line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = columns(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), words_of(text).alias("words"), F.split(text, "\n", -1).alias("lines")
    )

    def occurrences(chars: str) -> Column:
        return (F.char_length("text") - F.char_length(F.translate("text", chars, ""))).cast("long")

    filled = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        occurrences(SYMBOLS).alias("n_symbols"),
        occurrences("!").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size("lines").cast("long").alias("n_lines"),
        let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    No user function and no shuffle. Null and empty texts have no words and fail; identifiers are only
    carried, so null or repeated ones are kept as they are. Further columns of ``docs`` are ignored.
    """
    c = counts(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))

    def broken(r: Rule) -> Column:
        ratio = F.expr(f"try_divide({r.ratio.replace('/', ',')})")
        out = F.lit(False)
        if r.least is not None:
            out = out | (ratio < r.least)
        if r.most is not None:
            out = out | (ratio > r.most)
        return F.when(out, F.lit(r.name))

    names = F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return c.select("*", failed.alias("base_failed"), names.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
