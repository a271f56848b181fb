"""URL filters: rules for hosts and paths, and trust and distrust over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.llm.common import columns, cut, lower_ascii

ALLOW, BLOCK = "allow", "block"
#: The host of a link; links without one lead to the page's own host. Possessive, so that runs of blanks stay linear.
_GAP = r"[\x20\x09-\x0D]*+"
LINK_HOST = rf"""[\x20\x09-\x0D"'/][hH][rR][eE][fF]{_GAP}={_GAP}(?:["']{_GAP})?+(?:[A-Za-z][A-Za-z0-9+.-]*+:)?+//([^/?#"'\x20\x09-\x0D<>\\]++)"""
#: All trust, and all distrust, in whole units: sums do not depend on the order of rows.
UNITS = 10**15
#: Per cent of a host's score that it passes on over its links.
PASSED = 85
ROUNDS = 20


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` (lower case) and all its subdomains, where the path of the url begins with ``path``."""

    host: str
    path: str
    verdict: str

    def __post_init__(self) -> None:
        if self.verdict not in (ALLOW, BLOCK) or not self.host:
            raise ValueError(f"a rule needs a host and allows or blocks: {self}")

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one, or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` with ``host, path, rule, rule_verdict``: the longest rule that fits, else nulls; one projection.

    Of rules of one length, the one with the longer host counts, then the one listed first.
    """
    p = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))

    def fits(r: Rule) -> Column:
        return ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))

    def first(value: str) -> Column:
        none = F.lit(None).cast("string")
        return reduce(lambda rest, r: F.when(fits(r), F.lit(getattr(r, value))).otherwise(rest), reversed(order), none)

    return p.withColumns({"rule": first("name"), "rule_verdict": first("verdict")})


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, counted; the counts are combined before the shuffle."""
    found = F.explode(F.regexp_extract_all("html", F.lit(LINK_HOST), F.lit(1)))
    every = pages.where("host <> ''").select(F.col("host").alias("src"), found.alias("dst"))
    return every.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _share(of: str, part: str, whole: str) -> str:
    """``of * part / whole``, rounded down; the product may exceed 64 bits."""
    return f"cast({of} AS decimal(18,0)) * cast({part} AS decimal(18,0)) div {whole}"


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``host, n_allow, n_block`` and ``src, dst, n``.

    Trust is a personalised PageRank: a host keeps 15 % of its share of the allowed pages and gets 85 % of what the
    hosts that link to it have, each dividing its own over its links. Distrust is the same from the blocked pages
    over the links turned round: who links to a blocked host gets a part of its distrust. What a host without links
    would pass on is lost. Scores are whole units, ``UNITS`` in all, divided rounding down; they can only grow from
    round to round, and the rounds end when none does, after ``rounds`` at the latest. Each round is one join on the
    giving host and one sum per receiving host, combined before the shuffle, and is cut; both scores go together.
    """
    ways = cut(
        links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(
            links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        )
    )
    ways = ways.join(ways.groupBy("kind", "src").agg(F.sum("n").alias("n_all")), ["kind", "src"])
    ways = cut(ways)
    long_seeds = seeds.select(
        "host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("n_allow").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("n_block").alias("n")))).alias("s")
    ).select("host", "s.kind", "s.n").where("n > 0")
    total = long_seeds.groupBy("kind").agg(F.sum("n").alias("n_all"))
    base = long_seeds.join(total, "kind").select("kind", "host", F.expr(_share(str(UNITS * (100 - PASSED) // 100), "n", "n_all")).alias("score"))
    base = cut(base)
    state, before = base, None
    for _ in range(rounds):
        given = ways.join(state.withColumnRenamed("host", "src"), ["kind", "src"])
        given = given.select("kind", F.col("dst").alias("host"), F.expr(f"({_share('score', 'n', 'n_all')}) * {PASSED} div 100").alias("score"))
        state = cut(base.unionAll(given.groupBy("kind", "host").agg(F.sum("score").alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        now = tuple(state.agg(F.count_if(F.col("score") > 0), F.sum(F.col("score").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return state.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).cast("long").alias(k) for k in ("trust", "distrust")]
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, trust, distrust, verdict``: one row per row of ``pages``.

    A page with a rule gets its verdict. Any other gets its host's: blocked if the host's distrust exceeds its trust
    (see ``propagate``; the seeds are the pages that a rule allows or blocks, counted per host). So a host without
    either, known to nobody, is allowed, and equal scores allow.

    Null urls, and those without ``://``, have an empty host and path, fit no rule and are allowed; null html has no
    links. Rows are judged one by one, so null and repeated identifiers stay; repeated pages count as often as
    they stand there. Further columns are ignored; an empty table gives an empty one.
    """
    p = apply_rules(columns(pages, "page_id", "url", "html"), rules)
    seeds = p.where("host <> '' AND rule_verdict IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == ALLOW).alias("n_allow"), F.count_if(F.col("rule_verdict") == BLOCK).alias("n_block")
    )
    scores = propagate(seeds, host_links(p), rounds)
    judged = p.select("page_id", "host", "path", "rule", "rule_verdict").join(scores, "host", "left")
    by_host = F.when(F.coalesce(F.col("distrust") > F.col("trust"), F.lit(False)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select(
        "page_id", "host", "path", "rule",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("trust", "distrust")],
        F.coalesce("rule_verdict", by_host).alias("verdict"),
    )
