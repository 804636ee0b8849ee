"""Brute-force versions of the operators, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(rows, percent, size=5):
    """doc_id -> (set size, component, kept)."""
    sets = {}
    for doc, text in rows:
        w = spaced(lower(text))
        sets[doc] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc in sorted(sets):
        common = Counter(other for e in sets[doc] for other in holders[e])
        for other, both in common.items():
            if 100 * both >= percent * (len(sets[doc]) + len(sets[other]) - both):
                a, b = sorted((find(doc), find(other)))
                parent[b] = a
        for e in sets[doc]:
            holders[e].append(doc)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    texts = [(text or "").encode() for _, text in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(bool(r) for r in bytes(gone).split(b"\0"))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def contaminated(rows, items, size=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= {str(i) for i in windows[tuple(w[k : k + n])] if i is not None}
                    hit[k : k + n] = [1] * n
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), sum(hit), len(found), names, any(hit)))
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = spaced(text)
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = [0] * len(w)
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            inside[k : k + 3] = [1] * 3
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(inside))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def maximal_segments(scores):
    """All maximal scoring segments by their definition: cut out the greatest, go on left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return maximal_segments(scores[:i]) + [best] + [(a + j, b + j, t) for a, b, t in maximal_segments(scores[j:])]
