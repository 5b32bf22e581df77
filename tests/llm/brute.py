"""Plain versions of the operators' definitions, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(item)
    found = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    ids |= {str(x) for x in windows[key] if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        found.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return Counter(found)


def removals(docs, length):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in docs]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    found = []
    for doc_id, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        found.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(found)


def groups(size, linked):
    roots = list(range(size))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in range(size):
        for b in range(a):
            if linked(a, b):
                low, high = sorted((root(a), root(b)))
                roots[high] = low
    return [root(x) for x in range(size)]


def near_duplicates(docs, count, similarity=80):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = min(count, len(w))
        sets.append({(n, *w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())

    def linked(a, b):
        return bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])

    of = groups(len(docs), linked)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[of[k]] = min(least.get(of[k], doc_id), doc_id)
    return Counter(
        (doc_id, len(sets[k]), least.get(of[k]), doc_id == least.get(of[k])) for k, (doc_id, _) in enumerate(docs)
    )
