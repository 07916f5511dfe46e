"""Plain single-process versions that the operators are held against."""

import numpy as np


def find_components(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def cosine_links(rows, threshold=0.95):
    """``rows``: (id, vector or None) with distinct ids -> {id: (n_links, component_id)}."""
    ids = [r[0] for r in rows]
    fine = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for d in {len(rows[i][1]) for i in fine}:
        of = [i for i in fine if len(rows[i][1]) == d]
        m = np.array([rows[i][1] for i in of], "f4").astype("f8")
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        x, y = np.nonzero(np.triu(m @ m.T >= threshold, 1))
        pairs += [(of[a], of[b]) for a, b in zip(x, y)]
    roots = find_components(len(rows), pairs)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, ids[i]), ids[i])
    n = np.zeros(len(rows), int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {ids[i]: (int(n[i]), least[roots[i]]) for i in range(len(rows))}


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def product_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``rows``: (id, vector, label) of usable vectors -> {id: (code, error, label_error)}, books; plain Lloyd in Python's integers."""
    import math

    rows = sorted(([i, [math.floor(scale * x) for x in v], lab] for i, v, lab in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return [], []
    w = len(rows[0][1]) // parts
    top = max(abs(c) for r in rows for c in r[1])
    x = np.array([r[1] for r in rows], object if 4 * w * top * top >> 62 else "i8")
    books = [[list(x[k, p * w : (p + 1) * w]) for k in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        at = np.zeros((len(rows), parts), int)
        off = np.zeros((len(rows), parts), object)  # Python's integers where 64 bits don't do
        for p in range(parts):
            mine, book = x[:, p * w : (p + 1) * w], np.array(books[p], x.dtype)
            for n in range(len(rows)):
                d = ((book - mine[n]) ** 2).sum(axis=1)
                at[n, p] = int(d.argmin())  # the first of the least
                off[n, p] = int(d[at[n, p]])
        return at, off

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for k in set(at[:, p]):
                mine = x[at[:, p] == k, p * w : (p + 1) * w]
                books[p][k] = [sum(map(int, c)) // len(mine) for c in mine.T]
    at, off = assign()
    errors = [int(e) for e in off.sum(axis=1)]
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for k in at[n]), errors[n], labels[r[2]]) for n, r in enumerate(rows)], books


def runs(ids, least_length=6, least_periods=4):
    """(start, length, period) of all runs that are long enough, by start, then period: every period at every place."""
    n, out = len(ids), []
    for q in range(1, n):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and ids[k] == ids[k + q]:
                k += 1
            size = k - s + q
            if k > s and size >= max(least_length, least_periods * q):
                w = ids[s : s + size]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.append((s, size, q))
            k += k == s or k < n - q
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """The contract's row for one document."""
    import zlib
    from fractions import Fraction

    w = words_of(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digests = sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def without_repeats(rows, length=50):
    """``rows``: (id, text) -> a row each: id, n_words, n_removed, hash of what is kept."""
    texts = [words_of(t) for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, texts):
        for a in range(len(w) - length + 1) if i is not None else ():
            k = tuple(w[a : a + length])
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for a in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[a : a + length])] < i:
                gone.update(range(a, a + length))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out
