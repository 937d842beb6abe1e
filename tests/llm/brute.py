"""Plain models of the operators, over lists of rows."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, window):
    """rows: (doc_id, text). For each: word count, removed count, kept words."""
    low = {}
    split = [(i, words(t)) for i, t in rows]
    order = float("inf")
    for i, w in split:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            low[k] = min(low.get(k, order), order if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if low[tuple(w[a : a + window])] < (order if i is None else i):
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingle_set(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[a : a + 2]) for a in range(max(1, len(w) - 1))} if w else set()


def components(n, links):
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def quality(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    again = {k for a in range(len(w) - 4) if seen[tuple(w[a : a + 5])] > 1 for k in range(a, a + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def mix_targets(sizes, weights, most):
    """sizes: source to words. Full sources leave the pool until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        pool = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in rest)
        target = {s: most * sizes[s] if s in full else pool * weight[s] / share for s in names}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
