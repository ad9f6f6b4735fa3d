"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORDS((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(texts, num=3, den=4):
    """id -> (set size, smallest id reached)."""
    sets = {k: shingles(v) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def repeats(texts, n=35):
    """row -> (words, removed, kept text)."""
    words = [WORDS(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def quality(text):
    w = WORDS(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def boilerplate(rows, least):
    """(text, site) -> texts without lines of three words or more that stand on `least` sites or more."""
    sites = defaultdict(set)
    bare = lambda x: x.strip(" \t\x0b\x0c\r")
    for text, site in rows:
        for x in (text or "").split("\n"):
            if len(WORDS(x)) >= 3 and site is not None:
                sites[bare(x)].add(site)
    return ["\n".join(x for x in (t or "").split("\n") if len(sites.get(bare(x), ())) < least) for t, _ in rows]
