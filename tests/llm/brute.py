"""Plain Python versions of the contracts, for small tables."""
from __future__ import annotations

import hashlib
import re
from itertools import combinations


def licenses(text: str | None):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def personal(text: str | None):
    text, found = text or "", []
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    for k, (kind, pattern, ok) in enumerate(rules):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if ok(m[0])]
    found.sort()
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    return [sum(x[3] == kind for x in found) for kind in ("email", "ip", "card", "phone")], hashlib.sha256(listed.encode()).hexdigest(), listed


def grams(text: str | None, n: int = 5) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near(rows: list[tuple]) -> dict:
    """{doc_id: (class_id, class_size, n_links, group_id)} at Jaccard 0.8."""
    sets = {d: grams(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    links, where = dict.fromkeys(sets, 0), {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {p for ds in where.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 9 * same >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    same_set = {}
    for d, s in sorted(sets.items()):
        same_set.setdefault(s or d, []).append(d)
    return {d: (ds[0], len(ds), links[d], top(d)) for ds in same_set.values() for d in ds}


def removed(rows: list[tuple], width: int = 100) -> dict:
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    first, bodies = {}, {d: (t or "").encode() for d, t in rows}
    for d in sorted(bodies):
        for i in range(len(bodies[d]) - width + 1):
            first.setdefault(bodies[d][i:i + width], (d, i))
    out = {}
    for d, body in bodies.items():
        gone = bytearray(len(body))
        for i in range(len(body) - width + 1):
            if first[body[i:i + width]] < (d, i):
                gone[i:i + width] = b"\1" * width
        rest = bytes(c for c, g in zip(body, gone) if not g)
        out[d] = (len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out
