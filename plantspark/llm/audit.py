"""Filter interaction audit: what each filter takes at each place of every order, from counts of failure masks."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.llm.common import columns, cut, let, words_of

#: Failure conditions over ``text`` (never null) and ``n_words``, ``n_distinct``, ``n_chars``, ``n_capitals``.
CONDITIONS: dict[str, str] = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_chars",
    "D": r"rlike(text, r'[#$%&*|]')",
}
#: The letter of the filter on copies, which looks at the whole table.
COPIES = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _own_failures(docs: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``doc_id, part, text_key, mask``: the bits of the conditions that a text alone decides; no shuffle."""
    d = columns(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    sizes = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    d = d.select(
        "*",
        sizes.alias("_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    ).withColumns({"n_words": F.col("_words.n").cast("long"), "n_distinct": F.col("_words.d").cast("long")})
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    mask = reduce(lambda a, b: a + b, bits, F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS) -> DataFrame:
    """``part, mask, good, toxic``: one row per row of ``docs``; bit i of the mask is set if filter i fails the document.

    The last bit is the copies: it is set if the same text stands under a smaller identifier anywhere. Texts are
    compared by SHA-256. The smallest identifier of a text is an aggregate combined before the shuffle, and rows
    find themselves in it by text and identifier, so a text with millions of copies is no hot key.

    A null text is empty, a null language is part ``''``; a row without an identifier is no copy and makes none,
    and has no labels. Rows repeating an identifier are documents of their own. Where ``labels`` repeats an
    identifier, one row with a 1 is enough; null labels are no label. Further columns are ignored.
    """
    own = cut(_own_failures(docs, conditions))
    first = own.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True))
    marks = columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    copy = F.when(F.col("is_first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(conditions))).otherwise(F.lit(0))
    return (
        own.join(first, ["text_key", "doc_id"], "left")
        .join(marks, "doc_id", "left")
        .select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    )


def fold_orders(masked: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step, filter``, the counts and ``shapley``, for every order of ``letters``, zeros included.

    Documents are first counted per part and mask (at most 2 to the number of filters cells a part). Each cell then
    folds over the array of all orders, a literal that travels with the plan: a fold carries whether the cell is
    still alive from step to step and weighs what happens there by the cell's counts. The arrays of a part's cells
    are summed element by element. Up to six filters (720 orders); an empty input has no part and no row.
    """
    if not 0 < len(letters) <= 6 or len(set(letters)) != len(letters):
        raise ValueError("one to six different letters")
    cells = masked.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    none = F.lit(0).cast("long")
    step_type = f"array<struct<filter_order:string,step:int,filter:string,{','.join(f'{c}:bigint' for c in COUNTS)}>>"

    def walk(order: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            letter = F.substring(order, k, F.lit(1))
            bit = F.pow(F.lit(2), F.instr(F.lit(letters), letter) - 1).cast("int")
            fails = F.col("mask").bitwiseAND(bit) != 0
            alive = state["alive"]

            def weigh(when: Column, weight: str = "n") -> Column:
                return F.when(when, F.col(weight)).otherwise(none)

            seen = F.struct(
                order.alias("filter_order"),
                k.alias("step"),
                letter.alias("filter"),
                weigh(alive & ~fails).alias("kept"),
                weigh(alive & fails).alias("removed"),
                weigh(~alive & fails).alias("redundant"),
                weigh(F.col("mask") == bit).alias("unique_fails"),
                weigh(alive & fails, "n_good").alias("good_lost"),
                weigh(alive & fails, "n_toxic").alias("toxic_lost"),
            )
            return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(seen)).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), F.array().cast(step_type).alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(letters))), start, step, lambda s: s["steps"])

    folded = cells.select("part", F.flatten(F.transform(orders, walk)).alias("steps"))

    def plus(a: Column, b: Column) -> Column:
        return F.struct(*[a[c].alias(c) for c in ("filter_order", "step", "filter")], *[(a[c] + b[c]).alias(c) for c in COUNTS])

    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("each")).select(
        "part", F.reduce(F.slice("each", 2, 1 << len(letters)), F.col("each")[0], lambda a, b: F.zip_with(a, b, plus)).alias("steps")
    )

    def share(letter: str) -> Column:
        return F.aggregate("steps", none, lambda s, x: s + F.when(x["filter"] == letter, x["removed"]).otherwise(none)).alias(letter)

    shared = merged.select("part", "steps", F.struct(*[share(x) for x in letters]).alias("_share"))
    rows = shared.select("part", "_share", F.explode("steps").alias("s")).select("part", "_share", "s.*")
    own_share = reduce(lambda found, x: found.when(F.col("filter") == x, F.col("_share")[x]), letters[1:], F.when(F.col("filter") == letters[0], F.col("_share")[letters[0]]))
    return rows.select("part", "filter_order", "step", "filter", *COUNTS, own_share.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, copies: str = COPIES) -> DataFrame:
    """Per part, order and step of the filters: documents kept, removed, redundant, failing this filter only, and labelled ones lost.

    Inputs as in ``masks``, rows as in ``fold_orders``; ``copies`` names the filter on copies.
    """
    return fold_orders(masks(docs, labels, conditions), "".join(conditions) + copies)
