"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

PLAIN = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(docs: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) for each row, sorted."""
    words = [PLAIN.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def leaks(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row, sorted."""
    grams = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams[tuple(w[i : i + window])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def shingles(text: str | None, n: int = 5) -> set:
    w = PLAIN.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(docs: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) for each row, sorted."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holds[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((doc, len(s), least[top(i)]) for i, ((doc, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)
