"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

import numpy as np


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, size=5):
    w = words(fold(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def joined(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, percent):
    """doc_id: (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = joined(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def repeated(rows, window=13):
    """doc_id: (words, removed, kept words)."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.get(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def close_pairs(rows, threshold):
    """(links by id, component by id) over (id, vector, label) rows."""
    good = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for k, (a, u, g) in enumerate(good):
        for b, v, h in good[k + 1 :]:
            if g == h and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links.append((a, b))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    ids = [r[0] for r in rows]
    return {i: n[i] for i in ids}, joined(ids, links)


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text or ""))


def pattern(template):
    """A template's markup as a regular expression over words that blanks part."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\||<<\d+>>|[^\s|\[\]<>]+", template):
        if part == "[[":
            out.append("(?:(?:")
        elif part == "]]":
            out.append("))?")
        elif part == "|":
            out.append(")|(?:")
        elif part.startswith("<<"):
            out.append("(?:[^ ]+ ){1,%s}" % part[2:-2])
        else:
            out += [w + " " for w in license_words(part)]
    return re.compile(" " + "".join(out))
