"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = WHITE.findall((text or "").translate(AZ))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_duplicates(rows: list[tuple[int, str | None]], k: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, least doc_id reachable)."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        shared: dict[int, int] = defaultdict(int)
        for s in sets[d]:
            for o in holders[s]:
                shared[o] += 1
            holders[s].append(d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(o), root(d)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(rows: list[tuple[int, str | None]], k: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id to (words, words removed, digest of what is kept)."""
    first: dict[tuple[str, ...], int] = {}
    words = {d: WHITE.findall(t or "") for d, t in rows}
    out = {}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), d) < d:
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 8, least: int = 2) -> dict[int, tuple[int, int, int, str, bool]]:
    windows: dict[tuple[str, ...], set[int]] = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
            sizes.add(n)
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(AZ))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[j : j + n]))) is not None:
                    hit[j : j + n] = [True] * n
                    found |= x
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= least)
    return out
