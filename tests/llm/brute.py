"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def repeats(rows, length):
    """(row number, n_bytes, n_removed, n_spans, sha256) by counting every string of `length` bytes."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def jaccard_components(rows, width, percent):
    """id -> (n_shingles, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = WORD.findall(lower_ascii(t or ""))
        sets.append((i, {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted([(i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)], key=str)


def rule_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {j + d for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
