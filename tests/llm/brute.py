"""Plain Python forms of the corpus operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np

SPACE = "[\x20\x09-\x0D]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    """Union by the smaller id."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def exact(rows):
    """doc_id -> (keep_id, group_size, kept, digest) for rows of distinct ids."""
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for bare, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(bare.encode()).hexdigest()
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, digest)
    return out


def shingle_set(text, size):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near(rows, size, percent):
    """doc_id -> (n_shingles, component_id, kept) for rows of distinct ids."""
    sets = {doc_id: shingle_set(text, size) for doc_id, text in rows}
    groups, seen = Groups(sets), []
    for a, one in sets.items():
        for b, two in seen:
            if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                both = len(one & two)
                if 100 * both >= percent * (len(one) + len(two) - both):
                    groups.join(a, b)
        if one:
            seen.append((a, one))
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def vectors(rows, cosine):
    """vec_id -> (n_links, component_id, kept) for rows of distinct ids."""
    known = []
    for vec_id, vector, label in rows:
        ok = vector is not None and label is not None and all(
            x is not None and np.isfinite(x) for x in vector
        )
        if ok and any(vector):
            v = np.array(vector, float)
            v /= np.abs(v).max()
            known.append((vec_id, v / np.linalg.norm(v), label))
    groups, links = Groups([r[0] for r in rows]), collections.Counter()
    for i, (a, one, label) in enumerate(known):
        for b, two, other in known[:i]:
            if label == other and len(one) == len(two) and one @ two >= cosine:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {r[0]: (links[r[0]], groups.find(r[0]), groups.find(r[0]) == r[0]) for r in rows}


_WORDS = ["password", "passwd", "secret", "token"]
_EITHER = ["".join(f"[{c}{c.upper()}]" for c in w) for w in _WORDS] + ["[aA][pP][iI]_?[kK][eE][yY]"]
_ASSIGN = re.compile(
    "(" + "|".join(_EITHER) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, form, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(form, text) if len(m[0]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def personal(text):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    found = [("email", m.start(), m.end()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for kind, form, low, high, check in (
        ("card", r"[0-9]([\x20-]?[0-9])+", 16, 19, luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15, lambda d: True),
    ):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and check(digits):
                found.append((kind, m.start(), m.end()))
    return found


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whitening(rows):
    """(vec_id, x) of the rows that count, the number and sums of the distinct vectors, and exactly n^3 V."""
    kept = []
    for vec_id, vector in rows:
        if vector and all(c is not None and np.isfinite(c) for c in vector):
            kept.append((vec_id, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in vector)))
    fit = sorted({x for _, x in kept})
    n = len(fit)
    sums = [sum(column) for column in zip(*fit)]
    gaps = [[n * v - s for v, s in zip(x, sums)] for x in fit]
    scatter = [[sum(g[i] * g[j] for g in gaps) for j in range(len(sums))] for i in range(len(sums))]
    return kept, n, sums, scatter


def phrases(rows, longest, least, percent, top):
    """The rows of the collocations of (lang, text)."""
    words, found = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found[lang, tuple(w[i : i + k])] += 1
    often = {p for p, a in found.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for lang, p in often:
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = lang, p[i : i + size]
                if 100 * found[lang, p] >= percent * found[part]:
                    gone.add(part)
    out = []
    for lang in words:
        scored = []
        for of, p in often - gone:
            if of == lang:
                a, n = found[lang, p], words[lang]
                cuts = []
                for k in range(1, len(p)):
                    left, right = found[lang, p[:k]], found[lang, p[k:]]
                    cuts.append((1000 * a * n // (left * right), k, left, right))
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right, n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def repeats(rows, min_words):
    """Per row (doc_id, n_words, n_removed, kept text), for rows (doc_id, text)."""
    first, parts = {}, []
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", text or "")
        order = (doc_id is None, doc_id or 0)
        parts.append((doc_id, order, w))
        for i in range(len(w) - min_words + 1):
            key = tuple(w[i : i + min_words])
            first[key] = min(first.get(key, order), order)
    out = []
    for doc_id, order, w in parts:
        gone = set()
        for i in range(len(w) - min_words + 1):
            if first[tuple(w[i : i + min_words])] < order:
                gone.update(range(i, i + min_words))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)
