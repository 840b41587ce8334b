"""Plain restatements of what the operators must give, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def jaccard(rows, n=5, percent=75):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = roots(sets, links)
    least = {}
    for i in sorted(sets):
        least.setdefault(root[i], i)
    return {i: (len(sets[i]), least[root[i]]) for i in sets}


def decontaminated(rows, items, window=10):
    out = {}
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == own[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def repeats(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            part = data[p : p + window]
            if part in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(part)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def line_classes(rows, edits, min_chars):
    places = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()]
    lines = sorted({x for _, _, x in places})
    links = [
        (a, b) for a, b in itertools.combinations(lines, 2)
        if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    ]
    root, first = roots(lines, links), {}
    for i, n, x in sorted(places):
        first.setdefault(root[x], (i, n))
    return sorted(
        (i, n, *first[root[x]], sum(x in pair for pair in links), (i, n) == first[root[x]]) for i, n, x in places
    )
