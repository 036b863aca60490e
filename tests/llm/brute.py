"""Plain Python versions of the operators, for small inputs."""

import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text, lowered=True):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text) if lowered else text or "")


def window_hits(text, items, window=10):
    """(n_words, n_hit, item ids) of one document; items: (id, text)."""
    w = alnum_words(text)
    hit, found = set(), set()
    for item, body in items:
        t = alnum_words(body)
        n = min(len(t), window)
        for k in range(len(t) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == t[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text, n=3):
    w = space_words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, percent=90):
    """{row number: (set size, smallest id of the component)} for (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(x for x in (i, least.get(top(k))) if x is not None) if i is not None or top(k) in least else None
    return {k: (len(sets[k]), least[top(k)]) for k in range(len(rows))}
