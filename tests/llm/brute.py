"""Plain versions of the operators, to test against."""

import hashlib
from collections import Counter, defaultdict


def repeats(docs):
    """[(doc_id, text)] with different ids -> {doc_id: (n_bytes, n_removed, n_spans, sha, kept)}."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest(), kept)
    return out


def probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near(docs):
    """[(doc_id, text)] with different ids -> {doc_id: least id of its class}."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holding = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holding[x].append(i)
    for i, s in sets.items():
        for o, n in Counter(o for x in s for o in holding[x] if o > i).items():
            if n >= 0.4 * len(s.keys() | sets[o].keys()) and probability_jaccard(s, sets[o]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(o)))
                parent[b] = a
    return {i: find(i) for i, _ in docs}


def targets(sizes):
    """[(source, size)] -> {source: target}: weights 5, 2, 1; 150 % of all; at most twice a source's size."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    capped, left = {}, dict(weight)
    while left:
        level = (1.5 * sum(sizes.values()) - sum(capped.values())) / sum(left.values())
        over = [s for s in left if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in left}
        for s in over:
            capped[s] = 2 * sizes[s]
            del left[s]
    return capped


def mix(docs):
    """[(doc_id, source, size)] with different ids -> {doc_id: [taken in each pass]}."""
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    goal = targets(sizes)
    shuffled = sorted(docs, key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), d[2]))
    upto, passes = Counter(), []
    for i, s, n in shuffled:
        upto[s] += n
        for e in (0, 1):
            passes.append(((upto[s] + e * sizes[s]) / goal[s] if goal[s] else 0.0, hashlib.md5(str("" if i is None else i).encode()).hexdigest(), n, e, i))
    left, taken = int(sum(goal.values())), {i: [0, 0] for i, _, _ in docs}
    for _, _, n, e, i in sorted(passes, key=lambda p: p[:4]):
        taken[i][e] = min(n, left)
        left -= taken[i][e]
    return taken
