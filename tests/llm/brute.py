"""Plain restatements of the contracts, for small inputs."""

import re


def blank_words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text, n=5):
    w = blank_words(text, lower=True)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def remove_repeats(texts, n):
    import collections
    words = [blank_words(t) for t in texts]
    count = collections.Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for j in range(n)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
