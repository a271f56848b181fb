"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def line_dedup(rows, min_docs=3, min_chars=20):
    """The text of each row after line de-duplication, with lines before and lines dropped."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(BLANKS).translate(UPPER)].add(doc)
    last = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(x.strip(BLANKS).translate(UPPER), doc) == doc]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def repeats(texts, width):
    """For each text as bytes: bytes removed, runs removed, what is left."""
    seen = Counter()
    for t in texts:
        seen.update(t[k : k + width] for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def shingles(text, n=5):
    w = [x.translate(UPPER) for x in words(text)]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(rows, percent):
    """For each row: set size and the smallest document that links reach."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        same = Counter(j for x in s for j in at[x])
        for j, n in same.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            at[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def language_model(rows, held_out, order, prior):
    """For each row: tokens, known tokens, training tokens, base score, score."""

    def tokens(text):
        return [w.translate(UPPER) for w in words(text)] + [""]

    def grams(w, n):
        padded = [""] * (n - 1) + w
        return [tuple(padded[k : k + n]) for k in range(len(w))]

    def full(w, n):  # the end stands before a text once
        return [g for k, g in enumerate(grams(w, n)) if k >= n - 2]

    counts = [Counter() for _ in range(order + 1)]
    for (_, text), out in zip(rows, held_out, strict=True):
        if not out:
            for n in range(1, order + 1):
                counts[n].update(full(tokens(text), n))
    total, types = sum(counts[1].values()), len(counts[1])
    result = []
    for _, text in rows:
        w = tokens(text)
        base = score = 0.0
        for k in range(len(w)):
            p = (counts[1][(w[k],)] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                if k >= n - 2:
                    g = grams(w, n)[k]
                    p = (counts[n][g] + prior * p) / (counts[n - 1][g[:-1]] + prior)
            score += math.log10(p)
        result.append((len(w), sum(counts[1][(x,)] > 0 for x in w), total, base, score))
    return result


def quality(text):
    """The counts of a text that need a loop."""
    w = words(text)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {j for k in at.values() if len(k) > 1 for i in k for j in range(i, i + 8)}
    filled = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(filled) - len(set(filled)), len(covered)


def fair_order(quotas):
    """Earliest deadline first over one round: the source of each slot."""
    names = sorted(quotas)
    slots = sum(quotas.values())
    done = dict.fromkeys(names, 0)
    order = []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * slots // quotas[s]), -quotas[s], s) for s in names if done[s] < quotas[s] and done[s] * slots // quotas[s] <= t]
        order.append(min(ready)[2])
        done[order[-1]] += 1
    return order


def personal(text):
    """Base spans by the patterns as they are written."""
    text = text or ""
    out = []

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
