"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(FOLD))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[s:s + k])].add(str(i) if i is not None else "")
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s:s + k])) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, unit, window, earlier):
    """Per row ``(id, n, removed, spans, kept sha)``."""
    split = (lambda b: [b[i:i + 1] for i in range(len(b))]) if unit == "bytes" else bytes.split
    rows = [(i, split((t or "").encode())) for i, t in docs]
    occ = defaultdict(list)
    for n, (i, w) in enumerate(rows):
        for s in range(len(w) - window + 1):
            occ[tuple(w[s:s + window])].append((math.inf if i is None else i, n, s))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            o = occ[tuple(w[s:s + window])]
            if (any(x[0] < (math.inf if i is None else i) for x in o) if earlier else len(o) > 1):
                gone[s:s + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = (b"" if unit == "bytes" else b" ").join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), spans, sha(kept)))
    return out


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[s:s + words]) for s in range(max(1, len(w) - words + 1)))


def jaccard(docs, words=3, percent=90):
    """``(id, set size, component)`` per row; rows that share an id are one."""
    sets = [(i, shingles(t, words)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def exact(docs, keep=max):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        out += [(i, best, len(ids), i == best and n == ids.index(best), sha(t.encode())) for n, i in enumerate(ids)]
    return out


def kneser_ney(trusted, order):
    """``f(gram) -> p`` of an interpolated modified Kneser-Ney model over
    strings of ``order`` character classes."""
    counts = {order: Counter(trusted)}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    d, total, freed = {}, {}, {}
    for m, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d[m] = []
        for k in (1, 2, 3):
            raw = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else 0.5 * k
            d[m].append(min(max(raw, 0.05), k))
        total[m], freed[m] = Counter(), Counter()
        for g, v in c.items():
            total[m][g[:-1]] += v
            freed[m][g[:-1]] += min(d[m][min(v, 3) - 1], v)

    def p(g):
        out = 1 / 4096
        for m in range(1, order + 1):
            x = g[len(g) - m:]
            if total[m][x[:-1]]:
                v = counts[m][x]
                own = v - min(d[m][min(v, 3) - 1], v) if v else 0
                out = (own + freed[m][x[:-1]] * out) / total[m][x[:-1]]
        return out

    return p


def char_grams(text, order):
    def cls(c):
        return c if c < 3072 else 3072 + ((c * 0x9E3779B1 & 0xFFFFFFFF) >> 22)
    padded = [2] * (order - 1) + [cls(ord(c)) for c in text]
    return [tuple(padded[k:k + order]) for k in range(len(text))]


def quality(docs, trusted_ids, order=4, quantile=0.99, margin=1.1, shrink=32):
    """``{row number: (perplexity, threshold)}`` for docs ``(id, text, lang)``."""
    grams = [char_grams(t or "", order) for _, t, _ in docs]
    taught = [i in trusted_ids for i, _, _ in docs]
    langs = {lang for (_, t, lang), k in zip(docs, taught) if k and t}
    model = {}
    for lang in langs | {"*"}:
        model[lang] = kneser_ney([g for gs, (_, _, x), k in zip(grams, docs, taught) if k and (lang == "*" or x == lang) for g in gs], order)
    logs = [sum(math.log(model[x if x in langs else "*"](g)) for g in gs) for gs, (_, _, x) in zip(grams, docs)]
    out, mean, limit = {}, {}, {}
    for key in langs | {"*"}:
        mine = [n for n, k in enumerate(taught) if k and grams[n] and (key == "*" or docs[n][2] == key)]
        mean[key] = -sum(logs[n] for n in mine) / sum(len(grams[n]) for n in mine)
    score = lambda n, key: (mean[key] * shrink - logs[n]) / (len(grams[n]) + shrink)
    for key in langs | {"*"}:
        mine = [n for n, k in enumerate(taught) if k and grams[n] and (key == "*" or docs[n][2] == key)]
        bins = sorted(math.ceil(score(n, docs[n][2]) * 1000) for n in mine)
        limit[key] = math.exp(bins[max(0, math.ceil(quantile * len(bins)) - 1)] / 1000) * margin
    for n, (_, _, lang) in enumerate(docs):
        key = lang if lang in langs else "*"
        out[n] = (math.exp(score(n, key)) if grams[n] else None, limit[key])
    return out


def licenses(docs, templates, percent=80):
    grams = lambda t: {f"{a} {b}" for w in [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.translate(FOLD))] for a, b in zip(w, w[1:])}
    sets = {n: grams(t) for n, t in templates.items()}
    out = []
    for i, t in docs:
        units = [("line", k, u) for k, u in enumerate((t or "").split("\n"))]
        units += [("paragraph", k, u) for k, u in enumerate(re.split(r"\n[ \t\r]*\n", t or "")) if "\n" in u]
        for kind, k, u in units:
            g = grams(u)
            best = min(((-2 * len(g & s) / (len(g) + len(s)), n) for n, s in sets.items() if 200 * len(g & s) >= percent * (len(g) + len(s)) and g),
                       default=None)
            if best:
                out.append((i, kind, k, best[1], round(-best[0], 6)))
    return out
