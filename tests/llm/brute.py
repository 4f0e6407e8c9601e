"""Plain versions of the corpus operators, one row at a time, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) per row; rows with one id don't precede each other."""
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, (order(d), i)), (order(d), i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (order(d), i):
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def jaccard_components(rows, size=3, percent=90):
    """(doc_id, n_shingles, component_id) per row, ids without nulls and used once."""
    sets = {}
    for d, t in rows:
        w = words(t, True)
        sets[d] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return [(d, len(sets[d]), root(d)) for d, _ in rows]


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """Base spans (kind, start, end)."""
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def bigram_scores(rows, held, mu):
    """Per row n_tokens, n_known, N, base score and score."""
    one, two, ctx = Counter(), Counter(), Counter()
    texts = [[*words(t, True), None] for _, t in rows]
    for (d, _), w in zip(rows, texts):
        if not held(d):
            one.update(w)
            for a, b in zip([0, *w], w):
                two[a, b] += 1
                ctx[a] += 1
    n, v = sum(one.values()), len(one)
    out = []
    for w in texts:
        p = [(one[t] + 1) / (n + v + 1) for t in w]
        score = sum(math.log10((two[a, b] + mu * q) / (ctx[a] + mu)) for a, b, q in zip([0, *w], w, p))
        out.append((len(w), sum(one[t] > 0 for t in w), n, sum(map(math.log10, p)), score))
    return out
