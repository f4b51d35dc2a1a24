"""Plain versions of what the operators compute."""

import hashlib
import math
import re
from collections import defaultdict


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def removed(rows, n):
    """id -> words, removed, hash of the kept ones."""
    first, words, out = {}, {}, {}
    for i, t in sorted(rows):
        words[i] = plain(t)
        for s in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][s : s + n]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def linked(rows, n, num, den):
    """id -> size of its set, least id reachable; and the number of links."""
    sets = {}
    for i, t in rows:
        w = plain(fold(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    inside, both = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            inside[x].append(i)
    for ids in inside.values():
        ids.sort()
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for (a, b), c in both.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            links += 1
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}, links


def hits(docs, items, n):
    """id -> words, words hit, items, hash of the items."""
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add(str(i))
    out = {}
    for i, t in docs:
        w = alnum(t)
        hit, found = [False] * len(w), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if got := windows.get(tuple(w[s : s + m])):
                    found |= got
                    hit[s : s + m] = [True] * m
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def levels(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target, by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        free = [s for s in names if s not in full]
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > most * sizes[s] + 1e-9}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def stretches(weights, window, least):
    """Lines up to the next dive after each surge, from the touching lines before it on."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, done = [], 0
    for i in range(len(weights)):
        if i >= done and weights[i] and sums[i] > least:
            a = max([k + 1 for k in range(i) if not weights[k]], default=0)
            done = min([k for k in range(i, len(weights)) if not sums[k]], default=len(weights))
            out.append((a, done))
    return out


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def earlier(strings):
    """(string, place) -> how much of the suffix there a smaller document of the group has; strings are (group, document, symbols)."""
    out = {}
    for g, d, x in strings:
        for p in range(len(x)):
            n = max((_common(x[p:], y[q:]) for g2, d2, y in strings if g2 == g and d2 < d for q in range(len(y))), default=0)
            if n:
                out[g * 100 + d, p] = n
    return out


def repeats(strings):
    """Length, places, first string and first place of each substring that can't be extended to either side at all its places."""
    out = []
    for g in {g for g, _, _ in strings}:
        places = defaultdict(list)
        for g2, d, x in strings:
            for p in range(len(x) if g2 == g else 0):
                for q in range(p + 1, len(x) + 1):
                    places[tuple(x[p:q])].append((d, p, x[p - 1] if p else ("start", d), x[q] if q < len(x) else ("end", d, p)))
        for sub, at in places.items():
            if len(at) > 1 and len({a[2] for a in at}) > 1 and len({a[3] for a in at}) > 1:
                d, p = min(a[:2] for a in at)
                out.append((len(sub), len(at), g * 100 + d, p))
    return sorted(out)


def longest(docs, items, n):
    """(document, item, begin, end) of each common stretch of n words or more, or of a whole shorter item, that lies in no longer one of the item."""
    out = set()
    for d, t in docs:
        a = alnum(t)
        for i, u in items:
            b = alnum(u)
            found = set()
            for p in range(len(a)):
                for q in range(len(b)):
                    if p and q and a[p - 1] == b[q - 1]:
                        continue
                    k = _common(a[p:], b[q:])
                    if k and (k >= n or k == len(b)):
                        found.add((p, p + k))
            out |= {(d, i, x, y) for x, y in found if not any((x2 <= x and y <= y2) and (x2, y2) != (x, y) for x2, y2 in found)}
    return sorted(out)


M64 = (1 << 64) - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def _polynomial(part):
    """Of bytes, A-Z counting as a-z."""
    byte = lambda b: _mix((b + 32 * (65 <= b <= 90) + 1) * 0x9E3779B97F4A7C15 & M64)
    return sum(byte(b) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(part)) & M64


def noisy_or(text, model):
    """1 - prod(1 - score) over the sentences, from the weights of words, their heads and tails."""
    bias, weights = model
    shift = 65 - len(weights).bit_length()
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)]
        if words:
            z = bias
            for w in words:
                z += weights[_mix((_polynomial(w) + len(w)) & M64) >> shift]
                for k, n, part in [(1, n, w[:n]) for n in (3, 4, 5, 6)] + [(2, n, w[-n:]) for n in (4, 5)]:
                    if len(w) > n:
                        z += weights[_mix((_polynomial(part) + 1000 * k + n) & M64) >> shift]
            none *= 1 - 1 / (1 + math.exp(-max(min(z, 30), -30)))
    return 1 - none


def rates(cells, target, most):
    """(size, n) cells -> size -> rate: the tilt found by halving."""
    mean = sum(s * n for s, n in cells) / sum(n for _, n in cells)
    rate = lambda t, s: most / (1 + math.exp(-max(min(t * s / mean, 60), -60)))
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * s * rate(mid, s) for s, n in cells) < target else (lo, mid)
    return {s: rate(lo, s) for s, _ in cells}


def languages(pages, model, pseudo=(4.0, 16.0)):
    """id -> language of (id, URL, text likelihoods, declared code) rows, by the fusion's formulas one page at a time."""
    names = model[0]
    k = len(names)

    def normal(logs):
        odds = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(odds) for x in odds]

    rows = []
    for i, url, logs, declared in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d+)?([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        codes = [c.lower().split("-")[0].split("_")[0] for c in path.split("/")]
        named = [c for c in codes if c in names][-1:] or [c for c in host.split(".")[:1] if c in names and "." in host] or [c for c in host.split(".")[1:][-1:] if c in names]
        rows.append((i, host, ".".join(host.split(".")[-2:]), declared if declared in names else None, named[0] if named else None, logs, normal(logs)))
    base = [1.0 + sum(r[6][j] for r in rows) for j in range(k)]
    base = [x / sum(base) for x in base]
    trust = {}
    for kind in (3, 4):
        held = [[0.2 + 5.0 * (a == b) + sum(r[6][b] for r in rows if r[kind] == names[a]) for b in range(k)] for a in range(k)]
        trust[kind] = [[math.log(held[a][b] / sum(held[c][b] for c in range(k))) for b in range(k)] for a in range(k)]
    out = {}
    for r in rows:
        prior = base
        for column, weight in ((2, pseudo[1]), (1, pseudo[0])):
            own = [max(sum(x[6][j] for x in rows if x[column] == r[column]) - r[6][j], 0.0) for j in range(k)]
            prior = [(own[j] + weight * prior[j]) / (sum(own) + weight) for j in range(k)]
        logs = [r[5][j] + math.log(prior[j]) + sum(trust[kind][names.index(r[kind])][j] for kind in (3, 4) if r[kind]) for j in range(k)]
        post = normal(logs)
        out[r[0]] = (names[post.index(max(post))], max(post))
    return out
