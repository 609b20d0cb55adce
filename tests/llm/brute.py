"""Plain versions of the text operators, on lists in one process, to compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def base_counts(text):
    words = WORDS(text or "")
    lines, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORDS(line):
            repeated += line in lines
            lines.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated,
            len(covered))


def unrepeated(rows, size=20):
    """(id, words, words left) of (id, text) rows, in order of id."""

    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = WORDS(text or "")
        gone = set()
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            if window in seen:
                gone.update(range(k, k + size))
            seen.add(window)
        out.append((key, len(words), [w for k, w in enumerate(words) if k not in gone]))
    return out


def fingerprint(text, size=3, seed=42):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS(lower)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=3):
    """Index of the class of each value under links of at most so many bits."""

    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(values))]


def top_k(rows, k=10):
    """(query, rank, id, score) of (id, integer vector) rows; every hundredth id asks."""

    out = []
    asked = {}
    for key, v in rows:
        if key % 100 == 0:
            asked[key] = max(asked.get(key, v), v)
    for key, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows
                        if i != key and len(v) == len(q))
        out += [(key, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def by_key(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return groups
