"""Plain versions of the operators, row by row, that the tests compare with."""

import hashlib
import re
from collections import defaultdict


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def contamination(docs, items, span=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    of = defaultdict(set)
    for item, text in items:
        w = split(text)
        t = min(len(w), span)
        for i in range(len(w) - t + 1 if t else 0):
            of[tuple(w[i:i + t])].add("" if item is None else str(item))
    lengths = {len(k) for k in of}
    out = []
    for id, text in docs:
        w, hit, found = split(text), set(), set()
        for t in lengths:
            for i in range(len(w) - t + 1):
                if tuple(w[i:i + t]) in of:
                    hit.update(range(i, i + t))
                    found |= of[tuple(w[i:i + t])]
        out.append((id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near(docs, size=3):
    sets = []
    for id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
        span = min(size, len(w))
        sets.append((id, frozenset(tuple(w[i:i + span]) for i in range(len(w) - span + 1)) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if (a is not None and a == b) or (x and y and 100 * len(x & y) >= 85 * len(x | y)):
                if x and y:
                    parent[root(i)] = root(j)
    low = {}
    for i, (id, x) in enumerate(sets):
        if id is not None:
            low[root(i)] = min(id, low.get(root(i), id))
    return [(id, len(x), low.get(root(i)) if x else id) for i, (id, x) in enumerate(sets)]


def windows(docs, length=50):
    first, rows = {}, []
    key = lambda id: (id is None, id or 0)
    for id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        rows.append((id, w))
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            first[k] = min(first.get(k, key(id)), key(id))
    out = []
    for id, w in rows:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < key(id):
                gone.update(range(i, i + length))
        out.append((id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def substrings(docs, length=200):
    data = [(id, (text or "").encode()) for id, text in docs]
    count = defaultdict(int)
    for _, b in data:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((id, len(b), sum(gone), spans, sha(kept)))
    return out
