"""Chains of annotation tables: a site inherits from a parent, that from its own, and the nearest value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantspark.plans.stored import stored

# ---------------------------------------------------------------- fixed values
CIRCLE = "E407"


class CircularInheritanceError(ValueError):
    """A node is its own ancestor."""


def _links(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """One parent per node, the smallest of several; a null parent is none."""
    return parents.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that never broadcasts it. Spark compares the size of stored files with its threshold; nodes as
    Parquet are much smaller than as rows, and tables that grow with the input would go through the driver in every round."""
    return df.hint("merge")


def _double(jumps: DataFrame) -> DataFrame:
    """Of ``node, jump``: where the jump from the jump leads; nodes past a root are left out."""
    onward = jumps.select(F.col("node").alias("jump"), F.col("jump").alias("_next"))
    return jumps.join(_shuffled(onward), "jump").select("node", F.col("_next").alias("jump"))


def inheritance_problems(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``node, problem, code`` of every node whose chain cannot be followed to a root.

    ``circle`` (code E407): the node is its own ancestor; ``below_circle`` (E407): its chain runs into one;
    ``several_parents``: rows of the node disagree, the smallest counts; ``unknown_parent``: the parent has no row of its
    own, and is taken for a root. Nodes whose chain is longer than there are nodes run in circles: jumps of one step
    are doubled until every chain has ended or outgrown the table, in as many rounds as a number of nodes has binary digits.
    Where jumps then land are the nodes of the circles, as whole turns leave a circle's nodes on it. Null nodes are
    left out, whole repeats count once, an empty table has no problem.
    """
    links = stored(_links(parents, node, parent), "parents")
    total = links.count()
    jumps, steps = links.where("parent IS NOT NULL").withColumnRenamed("parent", "jump"), 1
    while steps <= total:
        jumps = stored(_double(jumps), "jumps")
        steps *= 2
        if not jumps.limit(1).count():
            break
    on = jumps.select(F.col("jump").alias("node")).distinct().withColumn("_on", F.lit(True))
    kind = F.when(F.col("_on"), "circle").otherwise("below_circle")
    circles = jumps.select("node").join(_shuffled(on), "node", "left").select("node", kind.alias("problem"), F.lit(CIRCLE).alias("code"))
    several = parents.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.count_distinct(F.coalesce(F.col(parent).cast("string"), F.lit(""))).alias("n"))
    none = F.lit(None).cast("string").alias("code")
    several = several.where("n > 1").select("node", F.lit("several_parents").alias("problem"), none)
    unknown = links.where("parent IS NOT NULL").join(_shuffled(links.select(F.col("node").alias("parent"))), "parent", "left_anti")
    return circles.unionByName(several).unionByName(unknown.select("node", F.lit("unknown_parent").alias("problem"), none))


def inherit_chains(
    annotations: DataFrame,
    parents: DataFrame,
    name: str = "sensor",
    node: str = "node",
    parent: str = "parent",
    on_circle: str = "raise",
) -> tuple[DataFrame, DataFrame]:
    """Annotations of every node after inheritance, and the problems of :func:`inheritance_problems`.

    ``annotations`` has ``node``, ``name`` and any further columns, at most one row per node and name. A node has a row
    for each name that it or any ancestor annotates; each column holds the value of the nearest of them that has one,
    so a null never hides an inherited value. Chains may have any depth: in each round a node takes over what its jump
    has gathered over as many steps as the node itself, then the jumps double. A round is one join by node for the rows
    and one for the jumps, both written to the shared folder; there is no round per level.

    Nodes on or below a circle are an error, or with ``on_circle="report"`` have no rows. Nodes known only from
    ``annotations`` have no parent; those known only as nodes of ``parents`` inherit too. Null nodes have no parent and
    give nothing on. Empty tables give empty ones.
    """
    cols = [c for c in annotations.columns if c not in (node, name)]
    problems = stored(inheritance_problems(parents, node, parent), "inheritance-problems")
    bad = problems.where(F.col("code") == CIRCLE).select("node")
    if on_circle == "raise" and (first := bad.orderBy("node").first()):
        raise CircularInheritanceError(f"{CIRCLE}: {bad.count()} nodes inherit in a circle, e.g. {first['node']}")
    own = annotations.select(F.col(node).alias("node"), F.col(name).alias("name"), *cols)
    own = own.join(_shuffled(bad), "node", "left_anti")
    jumps = _links(parents, node, parent).where("parent IS NOT NULL").withColumnRenamed("parent", "jump").join(_shuffled(bad), "node", "left_anti")
    held, jumps = stored(own, "annotations"), stored(jumps, "jumps")
    while jumps.limit(1).count():
        far = held.select(F.col("node").alias("jump"), F.col("name").alias("_name"), *[F.col(c).alias(f"_far_{c}") for c in cols])
        given = jumps.join(_shuffled(far), "jump").drop("jump").withColumnRenamed("node", "_node")
        both = held.join(given, F.col("node").eqNullSafe(F.col("_node")) & F.col("name").eqNullSafe(F.col("_name")), "full_outer")
        inherited = F.col("_node").isNotNull()
        merged = both.select(
            F.coalesce("node", "_node").alias("node"),
            F.when(inherited, F.col("_name")).otherwise(F.col("name")).alias("name"),
            *[F.coalesce(c, f"_far_{c}").alias(c) for c in cols],
        )
        held, jumps = stored(merged, "annotations"), stored(_double(jumps), "jumps")
    return held.select(F.col("node").alias(node), F.col("name").alias(name), *cols), problems
