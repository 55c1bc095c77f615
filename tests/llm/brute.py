"""Plain versions of operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i: i + n]) for i in range(len(w) - n + 1)])


def near_duplicates(rows, n, pct):
    """``{key: (set size, component)}``; pairs are found by prefix filtering, which misses none."""
    sets = {k: shingles(t, n) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    same = defaultdict(list)
    for k, s in sets.items():
        if s:
            same[s].append(k)
    for keys in same.values():
        for k in keys:
            join(min(keys), k)
    reps = {min(v): s for s, v in same.items()}
    freq = Counter(x for s in reps.values() for x in s)
    index = defaultdict(list)
    for k in sorted(reps, key=lambda k: len(reps[k])):
        s = reps[k]
        prefix = sorted(s, key=lambda x: (freq[x], x))[: len(s) - -(-pct * len(s) // 100) + 1]
        near = {j for x in prefix for j in index[x]}
        for j in near:
            both = len(s & reps[j])
            if 100 * both >= pct * (len(s) + len(reps[j]) - both):
                join(k, j)
        for x in prefix:
            index[x].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}
