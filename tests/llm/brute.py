"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def repeats(docs: list[tuple[int | None, str | None]], window: int, words: bool):
    """Units, removed flags per document; a null id is larger than all others."""
    order = lambda d: float("inf") if d is None else d
    first: dict[tuple, float] = {}
    split = [(order(d), (t or "").encode().split() if words else (t or "").encode()) for d, t in docs]
    for d, u in split:
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, u in split:
        flags = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < d:
                flags[i : i + window] = [True] * window
        out.append((u, flags))
    return out


def runs(flags: list[bool]) -> int:
    return sum(f and not p for p, f in zip([False, *flags], flags))


def shingle_set(text: str | None, size: int) -> frozenset:
    words = ascii_lower(text or "").encode().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_components(docs: list[tuple[int, str | None]], size: int = 4, percent: int = 80):
    """Set size and smallest linked document per document, from an inverted index over all pairs that share a shingle."""
    sets = [shingle_set(t, size) for _, t in docs]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def base_scores(docs: list[tuple[int, str | None]]):
    """held_out, tokens, known tokens, training tokens and base score per document."""
    import math
    import zlib
    from collections import Counter

    split = [(d, ascii_lower(t or "").encode().split() + [None]) for d, t in docs]
    out = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in split]
    counts = Counter(w for (_, u), o in zip(split, out) if not o for w in u)
    total, distinct = sum(counts.values()), len(counts)
    per = math.log10(total + 0.1 * (distinct + 1))
    return [
        (o, len(u), sum(counts[w] > 0 for w in u), total, sum(math.log10(counts[w] + 0.1) - per for w in u))
        for (_, u), o in zip(split, out)
    ]
