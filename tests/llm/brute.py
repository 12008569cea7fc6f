"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(sets: dict, percent: int = 80) -> dict:
    """Smallest reachable key of each key, keys linked where their sets are similar."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = sorted((k for k in sets if sets[k]), key=lambda k: len(sets[k]))
    holders: dict = {}
    for k in keys:
        seen: dict = {}
        for x in sets[k]:
            for other in holders.get(x, ()):
                seen[other] = seen.get(other, 0) + 1
        for other, both in seen.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
        for x in sets[k]:
            holders.setdefault(x, []).append(k)
    return {k: find(k) for k in sets}


def near(texts: dict, shingle: int = 2) -> dict:
    sets = {}
    for k, t in texts.items():
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    reach = joined(sets)
    return {k: (k, len(sets[k]), reach[k], reach[k] == k) for k in texts}


def lines(texts: dict, size: int) -> dict:
    places: dict = {}
    for k in sorted(texts):
        for i, raw in enumerate((texts[k] or "").split("\n")):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line:
                places.setdefault(line, []).append((k, i))
    names = {places[x][0]: x for x in places}
    sets = {p: {x[i:i + size] for i in range(max(1, len(x) - size + 1))} for p, x in names.items()}
    reach = joined(sets)
    gone = {p for first, x in names.items() for p in places[x] if p != reach[first]}
    out = {}
    for k, t in texts.items():
        parts = (t or "").split("\n")
        kept = [x for i, x in enumerate(parts) if (k, i) not in gone]
        out[k] = (k, "\n".join(kept) if len(kept) < len(parts) else t, len(parts), len(parts) - len(kept))
    return out
