"""Personal data in text: plain detectors, and the same over a normalised text whose characters know their source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plantspark.llm.common import columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts; saying so keeps long runs linear.
QUAD = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Each @ is looked at once, with the run of local characters before it, so any text takes linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in QUAD.finditer(text) if all(map(_small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, index of the kind, end)`` in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if re.search(r"[0-9]", text):
        found += [(s, 1, e) for s, e in ips(text)]
        found += [(s, 2, e) for s, e in cards(text)]
        if "+" in text:
            found += [(s, 3, e) for s, e in phones(text)]
    return sorted(found)


# ------------------------------------------------------------------ disguises

#: Letters of other scripts that look like the ASCII letter.
LOOKALIKES = dict(
    zip(
        "аеорсхуіјѕԁһӏАВЕКМНОРСТХІЈЅοανρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcxyijsdhlABEKMHOPCTXIJSoavpiktuABEZHIKMNOPTYX",
        strict=True,
    )
)
#: Dashes, blanks and dots that print like the ASCII one.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "。": ".", "․": ".", "﹫": "@", "＋": "+"}
UNSEEN = frozenset("​‌‍⁠﻿­")

#: Digits spelled in English, German, French and Spanish.
SPELLED = {
    **{w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())},
    **{w: str(i) for i, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(i) for i, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(i) for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
    "oh": "0",
}
AT = "at|arobase|arroba"
DOT = "dot|punkt|point|punto"
PLUS = "plus|más"
#: Blanks before a bracket are tried from the first of them only, so that long runs of blanks stay linear.
_LEAD = r"(?:(?<!\s)\s+)?"
WRAPPED_AT = rf"{_LEAD}[\[({{<]\s*(?:{AT}|@)\s*[\])}}>]\s*"
WRAPPED_DOT = rf"{_LEAD}[\[({{<]\s*(?:{DOT}|\.)\s*[\])}}>]\s*"
LABEL = r"[A-Za-z0-9-]+"
_LABEL = re.compile(LABEL)
_LABELS = re.compile(rf"{LABEL}(?:\.{LABEL})*")
#: Last labels that make "x at y dot z" without brackets an address.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|dev|app|io|ai|me|tv|eu|uk|us|ca|au|de|at|ch|fr|be|es|mx|ar|it|nl|pl|pt|br|ru|jp|cn|in"
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
NUMBER_HINT = re.compile(rf"\b(?:{_NUMBER})\b")
NUMBER_TOKEN = re.compile(rf"\b(?:{_NUMBER}|{DOT}|{PLUS})\b|[0-9]|[.+]")
#: What stands between the signs of a number, and what a number can hold once they are plain.
BETWEEN, NUMERIC = re.compile(r"[\s,-]*"), frozenset("0123456789 ().+-")
#: The fewest digits that a detector asks for.
FEWEST = 4
_JOINT = rf"(?:\s+(?:{DOT})\s+|{WRAPPED_DOT}|\.)"
ADDRESS = re.compile(
    rf"(?i)(?:(?P<wrapped_at>{WRAPPED_AT})|(?P<bare_at>(?<=[a-z0-9])\s+(?:{AT})\s+(?={LABEL}(?:{_JOINT}{LABEL})*{_JOINT}(?:{ENDINGS})\b))|(?P<wrapped_dot>{WRAPPED_DOT})|(?P<bare_dot>(?<=[a-z0-9])\s+(?:{DOT})\s+(?=[a-z0-9])))"
)
#: A bare "at" with a plain dot in the word after it.
BARE_AT = re.compile(rf"[a-z0-9]\s+(?:{AT})\s+{LABEL}\.")


def _character(c: str) -> str:
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in MARKS:
        return MARKS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.decimal(c, None)
    return c if d is None else str(d)


def plain_characters(text: str) -> tuple[str, list[int]]:
    """The text with look-alikes as ASCII, and for each character the position of its source."""
    if text.isascii():
        return text, list(range(len(text)))
    chars, source = [], []
    for i, c in enumerate(text):
        if p := c if c < "\x80" else _character(c):
            chars.append(p)
            source.append(i)
    return "".join(chars), source


def _lower(text: str) -> str:
    """In lower case, each character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _number_edits(low: str) -> list[tuple[int, int, str]]:
    """``(start, end, sign)`` for the signs of each run of digits, dots and a plus before them that has a spelled digit."""
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []
    spelled = False

    def close() -> None:
        while run and run[-1][2] in ".+":
            run.pop()
        k = next((k for k, t in enumerate(run) if t[2] != "."), 0)
        if spelled:  # blanks between two digits go with the first
            out.extend((s, e2, p) for (s, _, p), (e2, _, _) in zip(run[k:], [*run[k + 1 :], (run[-1][1], 0, "")], strict=True))
        run.clear()

    for m in NUMBER_TOKEN.finditer(low):
        t = m[0]
        sign = SPELLED.get(t) or ("+" if t in ("plus", "más", "+") else t if len(t) == 1 else ".")
        if run and (sign == "+" or not BETWEEN.fullmatch(low, run[-1][1], m.start())):
            close()
            spelled = False
        run.append((m.start(), m.end(), sign))
        spelled = spelled or t in SPELLED
    close()
    return out


def _is_label(text: str, start: int, end: int, labels: re.Pattern = _LABEL) -> bool:
    """Whether exactly one label (or labels with plain dots) stands there; looks no further than it reaches."""
    m = labels.match(text, start, end)
    return m is not None and m.end() == end


def _after_at(text: str, end: int) -> bool:
    """Whether labels joined by dots stand between a plain @ and ``end``."""
    while end and (text[end - 1].isascii() and text[end - 1].isalnum() or text[end - 1] in ".-"):
        end -= 1
    return end > 0 and text[end - 1] == "@"


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, sign)``; a bare dot counts between digits, after an @ in the same address, or in the name before one."""
    out, live, waiting = [], -1, []
    for m in ADDRESS.finditer(text):
        kind, (s, e) = m.lastgroup, m.span()
        if kind in ("wrapped_at", "bare_at"):
            name = s
            for a, b in reversed(waiting):  # john dot smith at ...
                if not _is_label(text, b, name):
                    break
                out.append((a, b, "."))
                name = a
            out.append((s, e, "@"))
            waiting = []
        elif (
            kind == "wrapped_dot"
            or text[s - 1].isdigit() and text[e].isdigit()
            or live >= 0 and _is_label(text, live, s, _LABELS)
            or _after_at(text, s)
        ):
            out.append((s, e, "."))
        else:
            waiting.append((s, e))
            live = -1
            continue
        live = e
    return out


class View:
    """A text with edits made, each to one character, that knows the range each character stands for."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts, at, n = [], 0, 0
        self.places: list[int] = []
        self.ranges: list[Span] = []
        for s, e, p in sorted(edits):
            if s < at:
                continue
            parts += (text[at:s], p)
            n += s - at
            self.places.append(n)
            self.ranges.append((s, e))
            n += 1
            at = e
        parts.append(text[at:])
        self.text = "".join(parts)

    def span(self, start: int, end: int) -> Span:
        return self._range(start)[0], self._range(end - 1)[1]

    def _range(self, i: int) -> Span:
        k = bisect_right(self.places, i) - 1
        if k < 0:
            return i, i + 1
        s, e = self.ranges[k]
        return (s, e) if i == self.places[k] else (e + i - self.places[k] - 1, e + i - self.places[k])

    def holds_number(self) -> bool:
        """Whether an edit stands among signs of numbers with as many digits as any detector needs."""
        end = -1
        for place in self.places:
            if place < end:
                continue
            start = end = place
            while start and self.text[start - 1] in NUMERIC:
                start -= 1
            while end < len(self.text) and self.text[end] in NUMERIC:
                end += 1
            if sum(c.isdigit() for c in self.text[start:end]) >= FEWEST:
                return True
        return False


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in the source that only show after normalisation; of their kind, one that overlaps base spans must reach over them.

    Look-alikes are undone first. Then spelled digits and written-out @ and dots are undone one after the
    other, and each alone, since a word of an address may be a digit's; of spans that overlap, the longest counts.
    """
    plain, source = plain_characters(text)
    changed = len(plain) != len(text) or plain != text
    low = _lower(plain)
    views: list[tuple[View, ...]] = [(View(plain, []),)] if changed else []
    if _has_address(low) and (edits := _address_edits(plain)):
        views.append((View(plain, edits),))
    if NUMBER_HINT.search(low) and (edits := _number_edits(low)):
        numbers = View(plain, edits)
        if numbers.holds_number():
            views.append((numbers,))
        if _has_address(low) and (edits := _address_edits(numbers.text)):
            views.append((View(numbers.text, edits), numbers))
    if not views:
        return []
    hits: set[tuple[int, int, int]] = set()
    for chain in views:
        for s, kind, e in detect(chain[0].text):
            p, q = s, e
            for view in chain:
                p, q = view.span(p, q)
            first, last = source[p], source[q - 1] + 1
            if text[first:last] != chain[0].text[s:e]:
                hits.add((first, kind, last))
    found: list[tuple[int, int, int]] = []
    given = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # apart and in order
    taken: list[list[Span]] = [[] for _ in KINDS]
    for first, kind, last in sorted(hits, key=lambda h: (h[0] - h[2], h)):
        over = _overlapped(given[kind], first, last)
        if (first, last) in over or any(s < first or e > last for s, e in over) or _overlapped(taken[kind], first, last):
            continue
        taken[kind].insert(bisect_left(taken[kind], (first, last)), (first, last))
        found.append((first, kind, last))
    return sorted(found)


def _has_address(low: str) -> bool:
    return any(c in low for c in "[({<") or any(w in low for w in DOT.split("|")) or BARE_AT.search(low) is not None


def _overlapped(own: list[Span], first: int, last: int) -> list[Span]:
    """Those of the spans, apart and in order, that share a character with the range."""
    i = bisect_left(own, (first, first))
    i -= i > 0 and own[i - 1][1] > first
    return own[i : bisect_left(own, (last, last), i)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base_spans, spans`` for every row: arrays of ``kind, start, end`` in code points, end exclusive.

    ``base_spans`` are what the plain patterns find in the text; ``spans`` adds what they find once look-alikes,
    spelled digits and written-out @ and dots are undone, as the range in the source that was disguised, also where it reaches over a base span. Null
    and empty texts have no spans. Identifiers are carried as they are, null or repeated; further columns
    are ignored. Texts are taken whole, and one task needs memory for one batch of rows.
    """
    d = columns(docs, "doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = detect(text)
                base.append(_rows(found))
                every.append(_rows(sorted(found + disguised(text, found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, _ARROW_SPANS), pa.array(every, _ARROW_SPANS)],
                names=["doc_id", "base_spans", "spans"],
            )

    schema = T.StructType([d.schema["doc_id"], T.StructField("base_spans", SPANS), T.StructField("spans", SPANS)])
    return d.mapInArrow(scan, schema)
