"""Plain versions of the pair-finding operators."""

import itertools
import string
from collections import defaultdict


def near_groups(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    shared = defaultdict(int)
    for own in having.values():
        for a, b in itertools.combinations(sorted(own), 2):
            shared[a, b] += 1
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in sets}


def leaks(docs, bench, size=5):
    table = str.maketrans(string.punctuation, " " * len(string.punctuation))

    def shingles(t):
        w = (t or "").lower().translate(table).split()
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    own = [s for s in map(shingles, bench) if s]
    return {i for i, t in docs for has in [shingles(t)] if any(5 * len(s & has) >= 4 * len(s) for s in own)}
