"""Plain versions of operators 7 and 10, shared by tests."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """(id, text) rows -> per row (n_shingles, component)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(s), least[root(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def mixed(rows, weights=(5, 2, 1), epochs=3, seed="mix-1"):
    """(id, source, size, quality weight) -> per row (source_size, target, copies); distinct (id, size)."""
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = [s for s in order if s not in capped]
        share = (total - sum(epochs * size[s] for s in capped)) / sum(w[s] for s in left) if left else 0
        over = {s for s in left if w[s] * share > epochs * size[s]}
        if not over:
            break
        capped |= over
    target = {s: float(epochs * size[s]) if s in capped else w[s] * share for s in order}

    def key(doc, q):
        u = (int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / q

    out = {}
    for s in order:
        full = int(target[s] // size[s]) if size[s] else 0
        budget, so_far = target[s] - full * size[s], 0
        for k, doc, n, i in sorted((key(d, q), d, n, i) for i, (d, src, n, q) in enumerate(rows) if src == s):
            take = budget > 0 and so_far + n / 2 <= budget
            so_far += n
            out[i] = (size[s], target[s], full + take)
    return [out[i] for i in range(len(rows))]
