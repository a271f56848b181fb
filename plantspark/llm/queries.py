"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.llm import audit, chat, decontam, langid, lines, lm, mixing, neardup, negatives, pii, quality, suffix, urls
from plantspark.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The six blanks of a word's ends, in SQL.
SQL_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ language


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


# ------------------------------------------------------------------ repeated strings


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=400)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ lines

LINES_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT row_no, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM texts),
keyed AS (
  SELECT *, translate(trim(line, {SQL_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_common_lines(docs, min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ chat formatting

#: The tools that the derived conversations call.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query", "limit"], "additionalProperties": False},
    "count": {"properties": {"text": {"type": "string"}, "unit": {"enum": ["word", "character"]}}, "required": ["text"]},
}


def tool_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with each user turn as a call and each reply to one as its result.

    The table holds no calls, so they are made from its whole rows: the tool, its arguments (some outside
    their schema) and what a call needs follow from the row. System turns stay messages.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    h = F.crc32(F.concat_ws(":", "conv_id", "turn"))

    def name(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), "conv_id", turn)

    need = F.when(F.col("turn") >= 2, F.array(F.when(h % 7 == 0, name(F.col("turn") + 2)).otherwise(name(F.col("turn") - 2))))
    search = F.struct(F.col("text").alias("query"), (F.char_length("text") % 130).alias("limit"))
    count = F.struct(F.when(h % 5 > 0, F.col("text")).alias("text"), F.when(h % 3 == 0, F.lit("word")).when(h % 3 == 1, F.lit("line")).alias("unit"))

    def call(tool: str, arguments: Column) -> Column:
        one = F.struct(name(F.col("turn")).alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"), need.alias("after"))
        return F.to_json(F.struct(F.array(one).alias("tool_calls")))

    reply = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    text = (
        F.when((F.col("role") == "user") & (h % 2 == 0), call("search", search))
        .when(F.col("role") == "user", call("count", count))
        .when(F.col("role") == "assistant", reply)
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"))


@query("op4_chat_format")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link_tool_calls(tool_conversations(spark, sf_dir), TOOLS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


# ------------------------------------------------------------------ personal data


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the base spans, which the plain patterns define; ``spans`` also has the disguised ones."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed("base_spans"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


# ------------------------------------------------------------------ decontamination


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_copies(docs, table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------------ language model


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs.withColumn("held_out", fold(F.col("doc_id"), 7) == 2), order=3)


# ------------------------------------------------------------------ near-duplicates


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).drop("text_hash")


# ------------------------------------------------------------------ mixing

MIX_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, ceil(sqrt(count(*)))::BIGINT AS w, ((count(*) + 31) // 32)::BIGINT AS b FROM documents GROUP BY source),
common AS (SELECT list_reduce(list(w), lambda x, y: gcd(x, y)) AS g FROM sizes),
every AS (
  SELECT list(source ORDER BY source) AS names, list((w // g)::BIGINT ORDER BY source) AS w, list(b ORDER BY source) AS b,
         sum(w // g)::BIGINT AS total, sum(b)::BIGINT AS blocks FROM sizes, common),
rounds AS (
  SELECT names, w, total, CASE WHEN total <= blocks THEN w ELSE b END AS quota, CASE WHEN total <= blocks THEN total ELSE 0 END AS slots FROM every),
edf(t, done, pick, slot) AS (
  SELECT 0::BIGINT, [0::BIGINT for x in w], NULL::BIGINT, NULL::BIGINT FROM rounds
  UNION ALL
  SELECT here + 1, [done[k] + CASE WHEN k = p THEN 1 ELSE 0 END for k in range(1, len(done) + 1)], p, here
  FROM (SELECT done, here,
               list_sort([{'deadline': ((done[k] + 1) * total + w[k] - 1) // w[k], 'rank': -w[k], 'k': k}
                          for k in range(1, len(w) + 1) if done[k] < quota[k] AND (done[k] * total) // w[k] <= here])[1].k AS p
        FROM (SELECT done, w, total, quota,
                     greatest(t, list_min([(done[k] * total) // w[k] for k in range(1, len(w) + 1) if done[k] < quota[k]])) AS here
              FROM edf, rounds))
  WHERE p IS NOT NULL),
plan AS (
  SELECT slot, names[pick] AS source, quota[pick] AS q, w[pick] AS w, total, slots,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
  FROM edf, rounds WHERE pick IS NOT NULL),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM documents)
SELECT r.doc_id, r.source, (r.rank // 32)::BIGINT AS block,
       ((r.rank // 32) // p.q * p.slots + p.nth * p.total // p.w)::BIGINT AS release,
       ((r.rank // 32) // p.q * p.slots + ((p.nth + 1) * p.total + p.w - 1) // p.w)::BIGINT AS deadline,
       ((r.rank // 32) // p.q * p.slots + p.slot)::BIGINT AS slot,
       (((r.rank // 32) // p.q * p.slots + p.slot) * 32 + r.rank % 32)::BIGINT AS position
FROM ranked r JOIN plan p ON p.source = r.source AND p.nth = (r.rank // 32) % p.q
"""


@query("op9_source_mix", MIX_SQL)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the unrounded natural weights, as the pipeline's last stage."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


# ------------------------------------------------------------------ quality rules

QUALITY_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT row_no, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS filled FROM texts),
windows AS (
  SELECT row_no, unnest(range(1, len(words) - 6)) AS i, words FROM parts WHERE len(words) >= 8),
windowed AS (
  SELECT row_no, i, count(*) OVER (PARTITION BY row_no, words[i:i+7]) AS n FROM windows),
repeated AS (
  SELECT row_no, count(DISTINCT w) AS n_repeat_words
  FROM (SELECT row_no, unnest(range(i, i + 8)) AS w FROM windowed WHERE n > 1) GROUP BY row_no),
counted AS (
  SELECT p.row_no, doc_id, len(words)::BIGINT AS n_words,
         length(translate(text, BLANKS, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         length(text) - length(translate(text, '!', '')) AS n_exclamations,
         len([x for x in words if lower(x) IN (STOPS)])::BIGINT AS n_stop_words,
         len([x for x in words if regexp_matches(x, '\p{L}')])::BIGINT AS n_letter_words,
         len(lines)::BIGINT AS n_lines,
         (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN repeated r ON p.row_no = r.row_no),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.25 AND n_exclamations / n_words <= 0.5
           AND n_stop_words / n_words >= 0.01 AND n_letter_words / n_words >= 0.6, n_words = 0)
         AND n_dup_lines / n_lines <= 0.5 AS passes
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept
FROM judged
""".replace("BLANKS", SQL_BLANKS).replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS))))


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *names)


# ------------------------------------------------------------------ filter interaction

AUDIT_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT doc_id, part,
         len(words) < 100 AS a,
         100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM parts),
marked AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS gone
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, fails,
         contains(fails, f) AS hit, gone <> '' AND regexp_matches(fails, '[' || gone || '_]') AS late
  FROM marked, steps),
summed AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT hit AND NOT late), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE hit AND NOT late), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE hit AND late), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (WHERE hit AND NOT late), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (WHERE hit AND NOT late), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit.audit_filters(docs, table(spark, sf_dir, "labels")).drop("filter")


# ------------------------------------------------------------------ urls

URL_RULES = (
    urls.Rule("org", "/", urls.ALLOW),
    urls.Rule("example.org", "/es/", urls.BLOCK),
    urls.Rule("example.org", "/en/1", urls.BLOCK),
    urls.Rule("com", "/fr/", urls.ALLOW),
    urls.Rule("com", "/de/", urls.BLOCK),
)


def _url_sql() -> str:
    """Rules by their table; the scores round by round, in whole units."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)
    sql = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT row_no, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fitting AS (
  SELECT row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no),
ruled AS (SELECT n.*, f.rule, f.rule_verdict FROM named n LEFT JOIN fitting f ON n.row_no = f.row_no),
found AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '[\x20\x09-\x0D"''/][hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*(?:["''][\x20\x09-\x0D]*)?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''\x20\x09-\x0D<>\\]+)', 1)) AS raw
  FROM named WHERE host <> ''),
links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM found) WHERE src <> dst GROUP BY ALL),
ways AS (
  SELECT kind, src, dst, n, sum(n) OVER (PARTITION BY kind, src) AS n_all
  FROM (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links)),
seeds AS (
  SELECT CASE rule_verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
  FROM ruled WHERE host <> '' AND rule IS NOT NULL GROUP BY ALL),
score0 AS (
  SELECT kind, host, ({urls.UNITS * (100 - urls.PASSED) // 100}::HUGEINT * n) // sum(n) OVER (PARTITION BY kind) AS score FROM seeds)"""
    for i in range(1, urls.ROUNDS + 1):
        sql += f""",
score{i} AS MATERIALIZED (
  SELECT kind, host, sum(score)::HUGEINT AS score FROM (
    SELECT * FROM score0 UNION ALL
    SELECT w.kind, w.dst, s.score * w.n // w.n_all * {urls.PASSED} // 100 FROM score{i - 1} s JOIN ways w ON w.kind = s.kind AND w.src = s.host)
  GROUP BY ALL)"""
    return sql + f""",
hosts AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) > coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS bad
  FROM score{urls.ROUNDS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(rule_verdict, CASE WHEN h.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN hosts h ON r.host = h.host
"""


@query("op12_url_filter", _url_sql())
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No page of the given tables links to another host, so a host without a rule is judged by its own pages' rules."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.drop("trust", "distrust")


# ------------------------------------------------------------------ hard negatives

NEGATIVES_SQL = """
WITH own AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.x, o.x)::BIGINT AS score
  FROM own a JOIN own o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)
