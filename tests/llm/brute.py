"""Plain answers to the contracts, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def contamination(docs, items, span=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(span, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows[tuple(w[a : a + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[g]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found), sha(names.encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(t):
    w = NONSPACE.findall(low(t))
    return frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs):
    """doc_id, set size, component; ids are distinct."""
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    having, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
            top[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def line_key(x):
    k = low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    return k if len(k) >= 40 else None


def line_dedup(docs):
    """doc_id, lines, lines dropped, kept text; ids are distinct."""
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if (k := line_key(x)) is not None:
                held[k].add(i)
    out = {}
    for i, t in docs:
        x = (t or "").split("\n")
        kept = [y for y in x if (k := line_key(y)) is None or len(held[k]) < 5 or max(held[k]) == i]
        out[i] = len(x), len(x) - len(kept), "\n".join(kept)
    return out


def quality(t):
    t = t or ""
    w = NONSPACE.findall(t)
    grams = [tuple(w[a : a + 8]) for a in range(len(w) - 7)]
    count = Counter(grams)
    covered = {a + k for a, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    own = [x for x in t.split("\n") if NONSPACE.search(x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered)
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def digest32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def revisits(pages):
    last = {}
    for i, h in pages:
        last[h or ""] = max(i, last.get(h or "", i))
    out = {}
    for i, h in pages:
        b, first = (h or "").encode(), last[h or ""]
        out[i] = (len(b), digest32(b), "response", None) if first == i else (len(b), digest32(b), "revisit", first)
    return out


def judge(url):
    at = (url or "").find("://")
    rest = re.split(r"[?#]", url[at + 3 :])[0] if at >= 0 else ""
    host, slash, path = rest.partition("/")
    host, path = low(host), slash + path
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return host, path, best and best[0], best[1] if best else "allow"


def toxic_features(t):
    w = ALNUM.findall(low(t))
    return {*w, *zip(w, w[1:], strict=False), *((a, None, b) for a, b in zip(w, w[2:], strict=False))}


def ftrl(rows, features=toxic_features, epochs=8, alpha=4.0, beta=1.0, l1=8.0):
    """A scorer learnt from (text, label) rows by FTRL-proximal, a coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f is None:
            return -z[f] / ((beta + n[f] ** 0.5) / alpha)
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + n[f] ** 0.5) / alpha)

    def score(fs):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(f) for f in fs if f in z) + weight(None)))))

    own, order = [(features(t), y) for t, y in rows], np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(own)):
            fs, y = own[i]
            g = score(fs) - y
            for f in [*fs, None]:
                step = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha
                z[f] += g - step * weight(f)
                n[f] += g * g
    return lambda t: score(features(t))
