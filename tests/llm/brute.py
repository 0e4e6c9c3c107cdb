"""Brute-force versions of the operators, and the small tables that they are held against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def runs_of(covered):
    return sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))


def phrase(docs, window=35):
    """doc rows (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    seen = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for k, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix(docs, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); null ids last."""
    order = lambda k: 2**63 - 1 if k is None else k
    least = {}
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            g = b[i : i + window]
            least[g] = min(least.get(g, 2**63 - 1), order(k))
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < order(k):
                gone[i : i + window] = [True] * window
        out.append((k, len(b), sum(gone), runs_of(gone), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, k):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(docs, k=3, percent=85):
    """(doc_id, n_shingles, component_id)."""
    sets = [shingles(t, k) for _, t in docs]
    ids = [d for d, _ in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[find(i)])) for i in range(len(docs))]
