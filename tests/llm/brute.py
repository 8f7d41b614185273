"""Plain reference computations for small inputs."""
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_components(docs, percent=75):
    """doc_id -> smallest linked doc_id, over {doc_id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    u = Union(sets)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
    return {i: u.root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def removed_spans(docs, width=35):
    """doc_id -> (words, words removed, kept text), over [(doc_id, text)]."""
    cut = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[k:k + width]) for _, w in cut for k in range(len(w) - width + 1))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out
