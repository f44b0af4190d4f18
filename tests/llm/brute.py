"""Plain versions of the operators over Python lists; slow, and written without the library."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component, kept)} from (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = set()
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j > i)
        links |= {(i, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    roots = components(sets, links)
    return {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def repeats(docs, length):
    """[(n_bytes, n_removed, n_spans, kept)] for (doc_id, text) pairs in order."""
    data = [(t or "").encode() for _, t in docs]
    starts = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = [False] * len(d)
        for k in range(len(d) - length + 1):
            if starts[d[k : k + length]] > 1:
                covered[k : k + length] = [True] * length
        spans = sum(c and not before for c, before in zip(covered, [False, *covered], strict=False))
        out.append((len(d), sum(covered), spans, bytes(b for b, c in zip(d, covered, strict=True) if not c)))
    return out


def word_repeats(docs, words=51):
    """What is left of each (doc_id, text): without words covered by a repeated string of words, and the white space between these."""
    places = [[(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for _, t in docs]
    split = [[t[a:b] for a, b in p] for (_, t), p in zip(docs, places, strict=True)]
    starts = Counter(tuple(w[k : k + words]) for w in split for k in range(len(w) - words + 1))
    out = []
    for (_, t), p, w in zip(docs, places, split, strict=True):
        covered = {j for k in range(len(w) - words + 1) if starts[tuple(w[k : k + words])] > 1 for j in range(k, k + words)}
        left, at = [], 0
        for k in sorted(covered):
            if k - 1 not in covered:
                left.append(t[at : p[k][0]])
            at = p[k][1]
        out.append("".join([*left, t[at:]]))
    return out


def statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    again = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


def records(pages):
    """[(page_id, bytes, sha1, type, refers_to)] of (page_id, html) pairs."""
    newest = {}
    for i, h in pages:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, h in pages:
        data = (h or "").encode()
        old = len(data) >= 1000 and newest[h] not in (i, -1)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", newest[h] if old else None))
    return out


def cosine_links(vectors):
    """{vec_id: (n_links, component, kept)} of (vec_id, vector, label)."""
    good = [
        (i, v, x) for i, v, x in vectors
        if v and x is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    links = []
    for k, (i, v, x) in enumerate(good):
        for j, w, y in good[:k]:
            if x == y and len(v) == len(w):
                dot = sum(a * b for a, b in zip(v, w, strict=True))
                if dot / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w)) >= 0.98:
                    links.append((i, j))
    count = Counter(n for pair in links for n in pair)
    roots = components([i for i, _, _ in vectors], links)
    return {i: (count[i], roots[i], roots[i] == i) for i, _, _ in vectors}
