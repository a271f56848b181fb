"""Language-model scores: smoothed n-grams as states with failure arcs, counted over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.chunks import CHUNK_BYTES, cuts_of, pack, restore, squeeze, total_bytes, unpack
from plantspark.llm.common import columns, cut
from plantspark.llm.shingles import Words, mix

#: Longest n-gram, and how many observations the shorter n-gram counts for.
ORDER = 2
PRIOR = 8.0
#: The code of the end of a text, which also stands before its first word; no word has it.
END = np.uint64(0x452821E638D01377)
#: Longer texts are walked in pieces of this many tokens.
PIECE = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a chunk: for each order their distinct codes, sorted, and where each position's is among them."""

    def __init__(self, rows: pa.Table, order: int) -> None:
        words = Words()
        texts = [words.codes(t) for t in rows["text"].to_pylist()]
        # The end stands before each text and after it; a position is a token with what comes before it in its text.
        self.length = np.array([len(t) + 1 for t in texts], np.int64)
        edge = np.array([END])
        token = np.concatenate([x for t in texts for x in (t, edge)] or [np.zeros(0, np.uint64)])
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.length)
        del words, texts
        before = np.arange(len(token)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes, self.at, self.full = [], [], []
        code = mix(token)
        for n in range(1, order + 1):
            if n > 1:  # (the end, first word) is the longest n-gram a first word has
                earlier = np.empty_like(token)
                earlier[n - 1 :] = token[: len(token) - n + 1]
                earlier[before < n - 1] = END
                code = mix(code * _STEP + mix(earlier + np.uint64(n)))
            full = before >= n - 2
            own, at = np.unique(code[full], return_inverse=True)
            self.codes.append(own)
            self.at.append(at.astype(np.int32))
            self.full.append(full)


REQUEST = "chunk long, part int, n_order int, n long, codes binary, counts binary"


def requests(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    """For each chunk, order and range of codes: the distinct codes and how often the chunk's training texts have each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                rows = unpack(body)
                grams = Grams(rows, order)
                train = ~rows["held_out"].to_numpy().astype(bool)
                out = []
                for k in range(order):
                    learned = train[grams.text[grams.full[k]]]
                    counts = np.bincount(grams.at[k][learned], minlength=len(grams.codes[k])).astype(np.uint32)
                    cuts = cuts_of(grams.codes[k], parts)
                    for part in np.flatnonzero(np.diff(cuts)):
                        a, b = cuts[part], cuts[part + 1]
                        steps = np.diff(grams.codes[k][a:b], prepend=np.uint64(0))
                        out.append((chunk, int(part), k + 1, int(b - a), squeeze(steps), squeeze(counts[a:b])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        names=["chunk", "part", "n_order", "n", "codes", "counts"],
                    )

    return chunks.mapInArrow(scan, REQUEST)


def tallies(asked: DataFrame) -> DataFrame:
    """``chunk, part, n_order, n, totals, tokens, types``: the corpus count of each code, in the order asked.

    One range of codes is one group; ranges are as many as chunks, so a group's size stays what a chunk's is, and a
    frequent n-gram comes once from each chunk. ``tokens`` and ``types`` (on one row of a range, order 1) sum up to
    the training tokens and the distinct ones.
    """

    def total(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        codes = [np.cumsum(restore(r["codes"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
        every = np.concatenate(codes)
        own, at = np.unique(every, return_inverse=True)
        counts = np.concatenate([restore(r["counts"], r["n"], np.uint32) for r in rows])
        sums = np.bincount(at, counts, minlength=len(own)).astype(np.uint64)
        ends = np.cumsum([0, *(r["n"] for r in rows)])
        word = rows[0]["n_order"] == 1
        stats = [(int(sums.sum()), int((sums > 0).sum())) if word and i == 0 else (0, 0) for i in range(len(rows))]
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "part": pa.array([r["part"] for r in rows], pa.int32()),
                "n_order": pa.array([r["n_order"] for r in rows], pa.int32()),
                "n": pa.array([r["n"] for r in rows], pa.int64()),
                "totals": pa.array([squeeze(sums[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                "tokens": pa.array([s[0] for s in stats], pa.int64()),
                "types": pa.array([s[1] for s in stats], pa.int64()),
            }
        )

    return asked.groupBy("part", "n_order").applyInArrow(total, "chunk long, part int, n_order int, n long, totals binary, tokens long, types long")


#: Shuffle files of an execution go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Executions planned inside leave no shuffle files behind; for plans that run once, into the checkpoint folder."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


class Automaton:
    """The n-grams of a chunk as an automaton, with the counts that the whole corpus has of them.

    A state is a known context of up to ``order - 1`` words; state 0 is the empty one. The arc of a known n-gram leads
    from its context, at (count + prior * shorter) / (context + prior), to the longest known context that it ends in. Any
    other word takes the state's failure arc, at prior / (context + prior), to the context without its first word,
    and tries there; the empty context has an arc for each word.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, types: int, prior: float) -> None:
        self.order, words = len(totals), len(totals[0])
        p = (totals[0] + 1.0) / (tokens + types + 1)
        self.word_log = np.log10(p)
        number, size = [], 1  # the state of each n-gram that can be a context, 0 if it isn't known
        for k in range(self.order - 1):
            known = totals[k] > 0
            number.append(np.where(known, size + np.cumsum(known) - 1, 0))
            size += int(known.sum())
        self.word_target = number[0] if number else np.zeros(words, np.int64)
        end = int(np.searchsorted(grams.codes[0], mix(np.array([END]))[0])) if words else 0
        self.start = int(self.word_target[end]) if words else 0
        self.back, self.fail = np.zeros(size), np.zeros(size, np.int64)
        keys, logs, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        first = np.cumsum(grams.length) - grams.length
        shorter_at = grams.at[0]
        if number:
            own = number[0] > 0
            self.back[number[0][own]] = np.log10(prior / (totals[0][own] + prior))
        for k in range(1, self.order):
            place = np.flatnonzero(grams.full[k])
            at = np.full(len(grams.full[k]), -1, np.int64)
            at[place] = grams.at[k]
            where = np.zeros(len(totals[k]), np.int64)
            where[grams.at[k]] = place  # one place where each n-gram stands
            own = np.flatnonzero(totals[k] > 0)
            where = where[own]
            context = shorter_at[where - 1]
            if k == 1:
                context[np.isin(where, first)] = end
            shorter = shorter_at[where]
            count, seen = totals[k][own], totals[k - 1][context]
            longer = np.zeros(len(totals[k]))
            longer[own] = (count + prior * p[shorter]) / (seen + prior)
            p = longer
            keys.append(number[k - 1][context] * words + grams.at[0][where])
            logs.append(np.log10(p[own]))
            if k < self.order - 1:
                state = number[k][own]
                self.fail[state] = number[k - 1][shorter]
                self.back[state] = np.log10(prior / (count + prior))
                targets.append(state)
            else:
                targets.append(number[k - 1][shorter])
            shorter_at = at
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.words, self.key, self.log, self.target = words, key[order], np.concatenate(logs)[order], np.concatenate(targets)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each word in its state, and the state after it."""
        out, after, rest = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(rest):
            s, w = after[rest], word[rest]
            empty = s == 0
            out[rest[empty]] += self.word_log[w[empty]]
            after[rest[empty]] = self.word_target[w[empty]]
            rest, s, w = rest[~empty], s[~empty], w[~empty]
            key = s * self.words + w
            arc = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            hit = self.key[arc] == key if len(self.key) else np.zeros(len(key), bool)
            out[rest[hit]] += self.log[arc[hit]]
            after[rest[hit]] = self.target[arc[hit]]
            rest, s = rest[~hit], s[~hit]
            out[rest] += self.back[s]
            after[rest] = self.fail[s]
        return out, after


def traverse(grams: Grams, totals: list[np.ndarray], tokens: int, types: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base and of the model's probability of each token, given what comes before it in its text.

    Each text is walked once through the :class:`Automaton`, its state carried from token to token, all texts of the chunk
    side by side. Longer texts are walked in pieces, which start in the empty state ``order - 1`` tokens earlier and
    so reach the same state: it depends on no more tokens than that.
    """
    model = Automaton(grams, totals, tokens, types, prior)
    word = grams.at[0]
    begin = np.cumsum(grams.length) - grams.length
    lead, piece = model.order - 1, max(PIECE, model.order)
    n = -(-grams.length // piece)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(piece, np.repeat(grams.length, n) - nth * piece)
    warm = np.where(nth > 0, lead, 0)
    at = np.repeat(begin, n) + nth * piece - warm
    state = np.where(nth > 0, 0, model.start)
    order = np.argsort(-(size + warm), kind="stable")
    at, warm, state, size = at[order], warm[order], state[order], (size + warm)[order]
    own = np.zeros(len(word))
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        place = at[:live] + t
        p, state = model.step(state[:live], word[place])
        counts = t >= warm[:live]
        own[place[counts]] = p[counts]
    return model.word_log[word], own


def score_texts(docs: DataFrame, held_out: str = "held_out", order: int = ORDER, prior: float = PRIOR, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Tokens are the words with A-Z lower-cased, then one end. Counts come from the rows whose ``held_out`` column isn't
    true, all of them, for all n-grams up to ``order``; ``score`` is the log10 probability of the text under the
    smoothed model, ``base_score`` under add-one single words. Each chunk of texts asks for the corpus counts of
    its own n-grams and gets them back in the order asked. Null and empty texts are one end; a null flag is false;
    identifiers are carried, further columns ignored; an empty table gives an empty result.
    """
    d = columns(docs, "doc_id", "text", held_out).toDF("doc_id", "text", "held_out").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    parts = max(1, -(-total_bytes(d) // chunk_bytes))
    chunks = cut(pack(d, chunk_bytes))
    with released(d.sparkSession):
        answers = cut(tallies(requests(chunks, order, parts)))
    tokens, types = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("types")).first())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = sorted(right.select(["n_order", "part", "n", "totals"]).to_pylist(), key=lambda r: (r["n_order"], r["part"]))
        totals = [np.concatenate([restore(r["totals"], r["n"], np.uint64) for r in replies if r["n_order"] == k] or [np.zeros(0, np.uint64)]) for k in range(1, order + 1)]
        del replies
        for body in left["body"].to_pylist():
            rows = unpack(body)
            grams = Grams(rows, order)
            base, own = traverse(grams, totals, tokens, types, prior)
            n = len(rows)
            known = totals[0][grams.at[0]] > 0

            def per_text(x: np.ndarray) -> np.ndarray:
                return np.bincount(grams.text, x, minlength=n)

            out.append(
                pa.table(
                    {
                        "doc_id": rows["doc_id"],
                        "held_out": rows["held_out"],
                        "n_tokens": pa.array(grams.length),
                        "n_known": pa.array(per_text(known).astype(np.int64)),
                        "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                        "base_score": pa.array(per_text(base)),
                        "score": pa.array(per_text(own)),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = T.StructType(
        [d.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    )
    return chunks.groupBy("chunk").cogroup(answers.drop("tokens", "types").groupBy("chunk")).applyInArrow(score, schema)
