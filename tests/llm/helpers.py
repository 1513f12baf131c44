"""Plain-Python forms of the operators, and odd rows that all of them must take."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1
ODD_TEXTS = [None, "", " \t\r\n", "x", "a  b", "\x85 \x1c", "é　ü", "\n\n", "z" * 3000, "one▁two", "🙂 " * 50]


def odd_documents(first=900):
    rows = [(first + i, text, None if i % 3 else "en", "s", 0) for i, text in enumerate(ODD_TEXTS)]
    return [*rows, (None, "no id at all", "en", None, None), rows[3], rows[3]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def windows_removed(rows, size):
    """(id, words, removed, kept text) of (id, text) rows."""
    told = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in told:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in told:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_groups(rows):
    """(id, set size, smallest id reachable) of (id, text) rows with distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(a), root(i)) for i, a in sets)
