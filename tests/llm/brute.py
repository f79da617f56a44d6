"""Brute-force versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(t or "")


def base_scores(docs):
    ws = [(i, [*words(lower(t)), None]) for i, t in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, x in ws if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, x in ws]


def components(docs):
    sets, order = [], []
    for i, t in docs:
        w = words(lower(t))
        order.append(i)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in order}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = root(order[a]), root(order[b])
                parent[max(r, s)] = min(r, s)
    return [(i, len(s), root(i)) for i, s in zip(order, sets)]


def contaminated(docs, items):
    win = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            win.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in win}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in win:
                    hit.update(range(s, s + n))
                    found |= win[k]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def deduped(docs, window=35, history=()):
    seen = Counter(tuple(w[s : s + window]) for t in [*history, *(t for _, t in docs)] for w in [words(t)] for s in range(len(w) - window + 1))
    out = []
    for d, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def rules(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)
