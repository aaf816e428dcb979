"""Plain Python forms of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def words(t):
    return WORD.findall(t or "")


def removed(docs, length):
    """docs: unit sequences in order, with the id that orders them; which units go."""
    first = {}
    for key, units in docs:
        for s in range(len(units) - length + 1):
            w = units[s : s + length]
            first[w] = min(first.get(w, (key, s)), (key, s))
    out = []
    for key, units in docs:
        gone = [False] * len(units)
        for s in range(len(units) - length + 1):
            if first[units[s : s + length]] < (key, s):
                gone[s : s + length] = [True] * length
        out.append(gone)
    return out


def near_classes(rows, limit=0.8):
    """{index: least index's class}: rows of (order, text); classes by links of similarity limit or more."""
    bags = []
    for _, t in rows:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            low, high = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
            if high and 10 * low >= 8 * high:
                root[find(i)] = find(j)
    least = {}
    for i, (order, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), order), order)
    return [least[find(i)] for i in range(len(rows))]
