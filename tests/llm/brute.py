"""Plain-Python versions of the operators' rules, written without their code."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from math import floor

import xxhash


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]", text or "") if w]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def decontaminate(docs, items, width=13):
    """[(n_words, n_hit, [item ids], contaminated)] for each text of ``docs``."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for s in range(max(1, len(w) - width + 1)):
                windows[tuple(w[s : s + width])].add(str(item))
    sizes = {len(g) for g in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[g]
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def mix(docs):
    """[(doc_id, size, source_size, target, taken)] for docs of (doc_id, text, source), by sharing the excess again and again."""
    rows = [(d, s, len(spaced(t))) for d, t, s in docs]
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, s, _ in rows) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(size.values())), list(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 3 * size[s]) for s in free)
        target = {s: min(t, 3.0 * size[s]) for s, t in target.items()}
        free = [s for s in free if target[s] < 3 * size[s]]
    out = []
    for s in names:
        own = sorted(((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], -(2**63) if d is None else d, n, d) for d, x, n in rows if x == s), key=lambda r: r[:3])
        whole = floor(target[s] / size[s] + 1e-9) if size[s] else 0
        rest, at = target[s] - whole * size[s], 0
        for _, _, n, d in own:
            out.append((d, n, size[s], target[s], n * (whole + (at + n / 2 <= rest + 1e-6))))
            at += n
    return out


def simhash(text):
    w = spaced(lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def jaccard(a, b):
    def grams(t):
        w = spaced(lowered(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def groups(n, linked):
    """The least index reachable from each of n."""
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label
