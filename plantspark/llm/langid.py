"""Language identification: scripts narrow the candidates, a switching path labels the words of mixed texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.common import columns

#: Letters only: digits and the underscore are no letters.
LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of ranges and the script that begins there ("" = none of interest).
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"),
    (0xFE00, ""), (0xFF21, "latin"), (0xFF66, "kana"), (0x20000, "han"), (0x30000, ""),
)
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([c for c, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])

#: Byte n-grams of a word with its two ends, hashed into this many features.
GRAMS = (1, 2, 3, 4)
FEATURES = 1 << 16
#: Rows of a language that are learned from at most, as many as a hash of the identifier picks on average.
FIT_ROWS = 3_000
#: A script is a language's own from this share of its words on.
SCRIPT_SHARE = 0.01
#: Natural-log units that a change of language costs, and how much of the evidence of overlapping n-grams counts.
SWITCH = 6.0
EVIDENCE = 0.4
#: Distinct words scored in one step.
SCORE_WORDS = 50_000
#: Words labelled together.
CHUNK_WORDS = 500_000


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: hashed n-grams of all words, and the number of the word each belongs to (rising)."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    blank = data == 32
    word = np.cumsum(blank) - 1  # the blank before a word belongs to it
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :]
        if n in GRAMS:
            inner = np.ones(len(code), bool)
            for k in range(1 if n > 1 else 0, n - 1 if n > 1 else 1):
                inner &= ~blank[k : k + len(code)]
            if n == 2:
                inner &= ~(blank[: len(code)] & blank[1 : 1 + len(code)])
            at = np.flatnonzero(inner)
            h = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(48)).astype(np.int64) % FEATURES, word[at]


def _scripts(words: list[str]) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, np.array([ord(w[0]) for w in words]), side="right") - 1]


@dataclass
class LanguageModel:
    """Log-probabilities of features by language, and which languages use which script."""

    langs: list[str]
    table: np.ndarray  # features x languages
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        scores = np.zeros((len(words), len(self.langs)), np.float32)
        for start in range(0, len(words), SCORE_WORDS):
            own = scores[start : start + SCORE_WORDS]
            for h, word in _grams(words[start : start + SCORE_WORDS]):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
                if len(first):
                    own[word[first]] += np.add.reduceat(self.table[h], first, axis=0)
        scores *= EVIDENCE
        scores -= scores.max(axis=1, keepdims=True)
        return np.where(self.allowed[_scripts(words)], scores, np.float32(-60.0))


def fit(docs: DataFrame, max_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang``.

    At most about ``max_rows`` rows of each language are used, picked by a hash of text and language; what comes
    to the driver are at most ``FEATURES`` counts for each language, and the languages are the label set.
    """
    d = columns(docs, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_rows / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    sample = d.where(spread < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = total.setdefault(lang, np.zeros(FEATURES + len(SCRIPTS), np.int64))
                if words := LETTERS.findall(text.as_py().lower()):
                    for h, _ in _grams(words):
                        own += np.bincount(h, minlength=len(own))
                    own[FEATURES:] += np.bincount(_scripts(words), minlength=len(SCRIPTS))
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "feature", "n"])

    counted = sample.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    at = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((FEATURES + len(SCRIPTS), len(langs)))
    lang_at = np.array([at[x] for x in rows["lang"].to_pylist()], int)
    np.add.at(n, (rows["feature"].to_numpy(), lang_at), rows["n"].to_numpy())
    grams, scripts = n[:FEATURES], n[FEATURES:]
    table = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * FEATURES))
    allowed = (scripts > 0) & (scripts >= SCRIPT_SHARE * scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script that no language has tells nothing
    return LanguageModel(langs, table.astype(np.float32), allowed)


def switching_paths(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each row of ``scores``; texts are runs of rows, given by first row and length.

    All texts step together from word to word, longest first, so a step is a few array operations on those that
    still have words.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n_langs = scores.shape[1]
    kind = np.uint8 if n_langs <= 256 else np.uint32
    back = np.empty(scores.shape, kind)
    keep = np.arange(n_langs, dtype=kind)
    live = len(length)
    longest = int(length[0]) if live else 0
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    value = scores[first] * 1.0
    for t in range(1, longest):
        live = alive[t]
        v = value[:live]
        best = v.argmax(axis=1)
        change = v[np.arange(live), best][:, None] - penalty
        rows = first[:live] + t
        back[rows] = np.where(change > v, best[:, None].astype(kind), keep)
        value[:live] = np.maximum(v, change) + scores[rows]
    out = np.empty(len(scores), kind)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        live = alive[t]
        rows = first[:live] + t
        out[rows] = state[:live]
        if t:
            state[:live] = back[rows, state[:live]]
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _label(texts: list[str | None], model: LanguageModel) -> Iterator[tuple[str, float, list[dict]]]:
    known: dict[str, int] = {}
    ids: list[int] = []
    length = []
    for text in texts:
        words = LETTERS.findall((text or "").lower())
        ids += [known.setdefault(w, len(known)) for w in words]
        length.append(len(words))
    words = list(known)
    at, length = np.array(ids, np.int64), np.array(length, np.int64)
    first = np.cumsum(length) - length
    some = length > 0
    paths = np.zeros(0, np.uint8)
    if words:
        paths = switching_paths(model.word_scores(words)[at], first[some], length[some])
    letters = np.array([len(w) for w in words], np.float64)[at] if words else np.zeros(0)
    n = len(model.langs)
    mass = np.bincount(np.repeat(np.arange(len(texts)), length) * n + paths, letters, minlength=len(texts) * n).reshape(-1, n)
    for i, text in enumerate(texts):
        if not length[i]:
            yield "und", 0.0, []
            continue
        best = int(mass[i].argmax())
        path = paths[first[i] : first[i] + length[i]]
        places = [m.span() for m in LETTERS.finditer(text)] if (path != path[0]).any() else None
        if places is None or len(places) != len(path):  # one language, or lower-casing changed the words
            ends = LETTERS.search(text).start(), len(text)
            spans = [{"start": ends[0], "end": ends[1], "lang": model.langs[best]}]
        else:
            cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1), len(path)]
            spans = [{"start": places[a][0], "end": places[b - 1][1], "lang": model.langs[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
        yield model.langs[best], float(mass[i, best] / mass[i].sum()), spans


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about ``CHUNK_WORDS`` words at six letters each; a longer text is a run of its own."""
    texts, room, start = [], CHUNK_WORDS * 6, 0
    for i, text in enumerate(column):
        text = text.as_py()
        if texts and room < len(text or ""):
            yield start, texts
            texts, room, start = [], CHUNK_WORDS * 6, i
        texts.append(text)
        room -= len(text or "")
    yield start, texts


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row.

    Words are runs of letters. Each gets a score by language from its n-grams, none for languages that don't use
    its script; the path of best total score, where each change costs ``SWITCH``, labels the words.
    ``lang_pred`` has most letters (ties: the first by name), ``score`` is its share of them, ``spans`` the
    stretches of one language in code points. A null text or one without a letter is ``und`` with score 0, and so
    is every text if the model knows no language. Identifiers are carried; further columns are ignored.
    """
    d = columns(docs, "doc_id", "text")
    shared = d.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES x languages

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, texts in _chunks(batch.column("text")):
                rows = list(_label(texts, m)) if m.langs else [("und", 0.0, [])] * len(texts)
                lang, score, spans = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        pa.array(lang, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(spans, _ARROW_SPANS),
                    ],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    schema = T.StructType(
        [d.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]
    )
    return d.mapInArrow(scan, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """``docs`` with all its columns, without rows whose text has no letter or no language with ``min_score`` of them.

    A text in two languages always has one with half of its letters, so it stays; a model that knows no language rejects only
    texts without a letter. Nothing is shuffled.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[str | None], m: LanguageModel) -> list[bool]:
        if not m.langs:
            return [bool(LETTERS.search(t or "")) for t in texts]
        return [lang != "und" and score >= min_score for lang, score, _ in _label(texts, m)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch.column(at)):
                yield batch.slice(start, len(texts)).filter(pa.array(good(texts, shared.value), pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
