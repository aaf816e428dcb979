"""Corrections found between two texts: shortest edit scripts in linear space, played back by Spark.

A script is an array of changes (at: characters before it in the first text, before, after), in order, that don't touch. It is
a shortest one: no other deletes and inserts fewer characters. A step of the search moves all diagonals of many pairs of texts
at once; what needs more places than are kept is cut at the middle of a shortest path, so that memory is bounded whatever the
script's length. Where one text is the other less some characters, there is no search.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SCRIPT = "array<struct<at int, before string, after string>>"
_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.string()), ("after", pa.string())]))
#: So many diagonals that still run along equal characters are followed one by one, by doubling steps.
_FEW = 4
#: Edits up to which a search keeps the places of all its steps instead of looking for its middle.
SHORT = 1024
#: So many pairs of texts are searched at once, step by step, and so many places (of 4 bytes) are kept for them.
TOGETHER, KEPT = 64, 1 << 24
#: Characters of a cut of a text that a script is played on.
CUT = 256
#: Sentinels behind each text, and the widest run of characters that is compared at once.
_PAD = 256


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    most, at, step = min(len(a), len(b)), 0, 64
    while at < most:
        end = min(most, at + step)
        apart = np.flatnonzero(a[at:end] != b[at:end])
        if len(apart):
            return at + int(apart[0])
        at, step = end, step * 2
    return most


def _advance(reach: np.ndarray, d: int, off: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One more edit on every diagonal k = -d, -d + 2, ...: reach[k + off] becomes the farthest place in a. Returns the ks."""
    n, m = len(a), len(b)
    low, high = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)
    k = np.arange(low, high + 1, 2)
    x = np.maximum(reach[k - 1 + off] + 1, reach[k + 1 + off])
    live = np.arange(len(k))
    while len(live):
        y = x[live] - k[live]
        ok = (x[live] < n) & (y < m) & (y >= 0)
        live, y = live[ok], y[ok]
        same = a[x[live]] == b[y]
        live = live[same]
        if 0 < len(live) <= _FEW:
            for i in live:
                x[i] += _common(a[x[i] :], b[x[i] - k[i] :])
            break
        x[live] += 1
    reach[k + off] = x
    return k


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place (x, y) through which a shortest path leads, neither its start nor its end. Both texts have something, and differ
    at either end."""
    n, m = len(a), len(b)
    delta, most = n - m, n + m
    off = most + 2
    ahead, back = np.full(2 * off + 1, -1, np.int64), np.full(2 * off + 1, -1, np.int64)
    ahead[1 + off] = back[1 + off] = 0
    ra, rb = a[::-1], b[::-1]
    for d in range(most // 2 + most % 2 + 1):
        k = _advance(ahead, d, off, a, b)
        if delta % 2:
            other = delta - k
            met = np.flatnonzero((np.abs(other) <= d - 1) & (back[other + off] >= 0) & (ahead[k + off] + back[other + off] >= n))
            if len(met):
                x = int(ahead[k[met[0]] + off])
                return x, x - int(k[met[0]])
        k = _advance(back, d, off, ra, rb)
        if not delta % 2:
            other = delta - k
            met = np.flatnonzero((np.abs(other) <= d) & (ahead[other + off] >= 0) & (back[k + off] + ahead[other + off] >= n))
            if len(met):
                x = int(back[k[met[0]] + off])
                return n - x, m - (x - int(k[met[0]]))
    raise AssertionError("two texts always meet")


def _short(a: np.ndarray, b: np.ndarray, most: int = SHORT) -> list[tuple[int, int, int, int]] | None:
    """The single edits of a script of ``most`` edits or fewer, from the farthest places of every step; else None."""
    n, m = len(a), len(b)
    off = most + 2
    reach, steps = np.full(2 * off + 1, -1, np.int64), []
    reach[1 + off] = 0
    for d in range(min(most, n + m) + 1):
        _advance(reach, d, off, a, b)
        if abs(n - m) <= d and (n - m - d) % 2 == 0 and reach[n - m + off] >= n:
            break
        steps.append(reach[off - d - 1 : off + d + 2].copy())
    else:
        return None
    out, x, y = [], n, m
    for d in range(len(steps), 0, -1):
        k, last = x - y, steps[d - 1]  # last[j + d] is the place on diagonal j
        down, right = (int(last[k + i + d]) if abs(k + i) < d else -1 for i in (1, -1))
        if down >= 0 and down >= right + 1 and down - k - 1 >= 0 or right < 0:
            x, y = down, down - k - 1
            out.append((x, x, y, y + 1))
        else:
            x, y = right, right - k + 1
            out.append((x, x + 1, y, y))
    return out[::-1]


def _short_all(pairs: list[tuple[np.ndarray, np.ndarray]], kept: int = KEPT) -> list[list[tuple[int, int, int, int]] | None]:
    """_short() of several pairs: a step moves the diagonals of all. None where ``kept`` places don't do."""
    ends = lambda side: np.array([len(p[side]) for p in pairs], np.int64)
    joined = lambda side, mark: np.concatenate([x for p in pairs for x in (p[side], np.full(_PAD, mark, "<u4"))])
    n, m = ends(0), ends(1)
    # The marks are no code points and differ, so that a run ends where either text does.
    a, b = joined(0, 0xFFFFFFFF), joined(1, 0xFFFFFFFE)
    from_a, from_b = (np.cumsum(x + _PAD) - x - _PAD for x in (n, m))
    rows = np.arange(len(pairs))  # pairs still searched, and some that are done
    off = 66
    reach = np.full((len(rows), 2 * off + 1), -1, np.int32)
    reach[:, 1 + off] = 0
    steps, where, edits = [], rows, np.full(len(pairs), -1)
    for d in itertools.count():
        kept -= len(rows) * (d + 1)
        if kept < 0:
            break
        if d + 2 > off:
            reach = np.pad(reach, ((0, 0), (off, off)), constant_values=-1)
            off *= 2
        k = np.arange(-d, d + 1, 2)
        x = np.maximum(reach[:, off - d - 1 : off + d : 2] + 1, reach[:, off - d + 1 : off + d + 2 : 2])
        at_a = (from_a[rows, None] + np.minimum(x, n[rows, None])).ravel()
        at_b = (from_b[rows, None] + np.minimum(x - k, m[rows, None])).ravel()
        live, width, flat = np.flatnonzero(a[at_a] == b[at_b]), 4, x.reshape(-1)
        at_a, at_b = at_a[live], at_b[live]
        while len(live):
            t = np.arange(width)
            apart = a[at_a[:, None] + t] != b[at_b[:, None] + t]
            run = apart.argmax(1)
            on = ~apart[np.arange(len(live)), run]
            run[on] = width
            flat[live] += run.astype(np.int32)
            live, at_a, at_b, width = live[on], at_a[on] + width, at_b[on] + width, min(width * 4, _PAD)
        reach[:, off - d : off + d + 1 : 2] = x
        steps.append((x, where))
        last = n[rows] - m[rows]
        there = (np.abs(last) <= d) & ((last - d) % 2 == 0) & (edits[rows] < 0)
        there[there] = x[there, (last[there] + d) // 2] >= n[rows[there]]
        edits[rows[there]] = d
        left = edits[rows] < 0
        if not left.any():
            break
        if left.sum() <= 0.75 * len(rows):
            rows, reach = rows[left], reach[left]
            where = np.full(len(pairs), -1)
            where[rows] = np.arange(len(rows))
    out: list[list[tuple[int, int, int, int]] | None] = []
    for i in range(len(pairs)):
        if edits[i] < 0:
            out.append(None)
            continue
        found, x, y = [], int(n[i]), int(m[i])
        for d in range(edits[i], 0, -1):
            k, (places, row) = x - y, steps[d - 1]  # places[row, (j + d - 1) // 2] is the place on diagonal j
            own = places[row[i]]
            down, right = (int(own[(k + e + d - 1) // 2]) if abs(k + e) < d else -1 for e in (1, -1))
            if down >= 0 and down >= right + 1 and down - k - 1 >= 0 or right < 0:
                x, y = down, down - k - 1
                found.append((x, x, y, y + 1))
            else:
                x, y = right, right - k + 1
                found.append((x, x + 1, y, y))
        out.append(found[::-1])
    return out


def _deletions(a: np.ndarray, b: np.ndarray, text: str) -> list[tuple[int, int]] | None:
    """The spans of a (whose characters are ``text``) without which it is b, or None if b isn't a without some characters."""
    spare, i, j, out = len(a) - len(b), 0, 0, []
    while i - j <= spare:
        same = _common(a[i:], b[j:])
        i, j = i + same, j + same
        if j == len(b):
            return out + [(i, len(a))] if i < len(a) else out
        to = text.find(chr(b[j]), i + 1, j + spare + 1)
        if to < 0:
            return None
        out.append((i, to))
        i = to
    return None


def edit_scripts(pairs: list[tuple[str, str]]) -> list[list[tuple[int, str, str]]]:
    """edit_script() of every pair; searches that are short go together."""
    out: list = [None] * len(pairs)
    todo = []
    for place, (a, b) in enumerate(pairs):
        if a == b:
            out[place] = []
            continue
        x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
        # Where one text is the other less some characters, no script is shorter than the difference of lengths.
        if len(x) > len(y) and (spans := _deletions(x, y, a)) is not None:
            out[place] = [(i, a[i:j], "") for i, j in spans]
        elif len(x) < len(y) and (spans := _deletions(y, x, b)) is not None:
            gone = np.cumsum([0, *(j - i for i, j in spans)]).tolist()
            out[place] = [(i - g, "", b[i:j]) for (i, j), g in zip(spans, gone)]
        else:
            head = _common(x, y)
            tail = _common(x[head:][::-1], y[head:][::-1])
            todo.append((place, head, x[head : len(x) - tail], y[head : len(y) - tail]))
    # Of like length, so that few wait for the longest.
    todo.sort(key=lambda t: len(t[2]) + len(t[3]))
    for k in range(0, len(todo), TOGETHER):
        some = todo[k : k + TOGETHER]
        for (place, head, *_), found in zip(some, _short_all([t[2:] for t in some])):
            a, b = pairs[place]
            if found is None:
                out[place] = edit_script(a, b, far=True)
                continue
            spans: list = []
            for i, j, p, q in found:
                if spans and spans[-1][1] == i and spans[-1][3] == p:
                    spans[-1] = (spans[-1][0], j, spans[-1][2], q)
                else:
                    spans.append((i, j, p, q))
            out[place] = [(head + i, a[head + i : head + j], b[head + p : head + q]) for i, j, p, q in spans]
    return out


def edit_script(a: str, b: str, far: bool = False) -> list[tuple[int, str, str]]:
    """The changes that make b of a. far: it is known that they are many, so the first search is for their middle."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    spans, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, j, p, q = todo.pop()
        head = _common(x[i:j], y[p:q])
        i, p = i + head, p + head
        tail = _common(x[i:j][::-1], y[p:q][::-1])
        j, q = j - tail, q - tail
        if i == j or p == q:
            if i < j or p < q:
                if spans and spans[-1][1] == i and spans[-1][3] == p:
                    spans[-1] = (spans[-1][0], j, spans[-1][2], q)
                else:
                    spans.append((i, j, p, q))
            continue
        few, far = None if far else _short(x[i:j], y[p:q]), False
        if few is not None:
            todo += [(i + u, i + v, p + w, p + z) for u, v, w, z in reversed(few)]
            continue
        u, v = _middle(x[i:j], y[p:q])
        todo += [(i + u, j, p + v, q), (i, i + u, p, p + v)]
    return [(i, a[i:j], b[p:q]) for i, j, p, q in spans]


def with_script(rows: DataFrame, keep: list[str], before: str, after: str) -> DataFrame:
    """rows' columns ``keep`` with ``script``; null where either text is null."""
    ship(rows.sparkSession)
    kept = rows.select(*keep)
    n = len(keep)

    def run(batches):
        for batch in batches:
            sides = list(zip(*(batch.column(n + k).to_pylist() for k in (0, 1))))
            scripts = iter(edit_scripts([s for s in sides if None not in s]))
            found = [None if None in s else [dict(zip(("at", "before", "after"), c)) for c in next(scripts)] for s in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _TYPE)], [*keep, "script"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"script {SCRIPT}"]
    return rows.select(*keep, F.col(before).alias("__b"), F.col(after).alias("__a")).mapInArrow(run, ", ".join(fields))


def play(text: Column, script: Column) -> Column:
    """The text after a script's changes; each is put where it belongs, so equal pieces elsewhere stay as they are. The text is
    cut once, and what stands between two changes is looked up in its cuts: time grows with the text and with the changes, not
    with their product."""
    end = lambda c: c["at"] + F.length(c["before"])
    start = lambda i: F.when(i == 0, 0).otherwise(end(F.get(script, i - 1)))

    def between(cuts: Column, i: Column, j: Column) -> Column:
        first, last = F.floor(i / CUT).cast("int"), F.floor((j - 1) / CUT).cast("int")
        head = F.substring(F.get(cuts, first), i % CUT + 1, j - i)
        rest = F.concat(F.array_join(F.slice(cuts, first + 2, last - first - 1), ""), F.substring(F.get(cuts, last), F.lit(1), j - last * CUT))
        return F.when(i >= j, "").when(first == last, head).otherwise(F.concat(head, rest))

    def played(cuts: Column) -> Column:
        parts = F.transform(script, lambda c, i: F.concat(between(cuts, start(i), c["at"]), c["after"]))
        return F.concat(F.array_join(parts, ""), between(cuts, end(F.element_at(script, -1)), F.length(text)))

    # As an argument of a function the cuts are made once, not for each change.
    cuts = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    return F.when(F.size(script) == 0, text).otherwise(F.get(F.transform(cuts, played), F.lit(0)))


def deleted(script: Column) -> Column:
    return F.aggregate(script, F.lit(0).cast("long"), lambda n, c: n + F.length(c["before"]))


def inserted(script: Column) -> Column:
    return F.aggregate(script, F.lit(0).cast("long"), lambda n, c: n + F.length(c["after"]))


def verdict(text: Column, script: Column, share: float = 0.1) -> Column:
    """What a correction did: same; cleaned (takes out or replaces at most ``share`` of the text); added (puts in what stands in
    place of nothing); rewritten (more than that)."""
    adds = F.exists(script, lambda c: (F.length(c["before"]) == 0) & F.rlike(c["after"], F.lit(r"\S")))
    far = deleted(script) + inserted(script) > share * F.length(text)
    return F.when(F.size(script) == 0, "same").when(adds, "added").when(far, "rewritten").when(script.isNotNull(), "cleaned")
