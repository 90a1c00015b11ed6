"""Brute-force versions of the operators' contracts, in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def covered(sequences, least):
    """Places of each sequence inside a window that also starts elsewhere."""
    seen = defaultdict(int)
    for s in sequences:
        for i in range(len(s) - least + 1):
            seen[s[i : i + least]] += 1
    out = []
    for s in sequences:
        flags = [False] * len(s)
        until = 0
        for i in range(len(s)):
            if i + least <= len(s) and seen[s[i : i + least]] > 1:
                until = i + least
            flags[i] = i < until
        out.append(flags)
    return out


def bytes_removed(texts, least=200):
    data = [(t or "").encode() for t in texts]
    rows = []
    for d, f in zip(data, covered(data, least)):
        runs = sum(1 for i, x in enumerate(f) if x and (i == 0 or not f[i - 1]))
        rows.append((len(d), sum(f), runs, sha(bytes(b for b, x in zip(d, f) if not x))))
    return rows


def words_removed(texts, least=35):
    words = [tuple(WORDS.findall(t or "")) for t in texts]
    return [(len(w), sum(f), sha(" ".join(x for x, y in zip(w, f) if not y))) for w, f in zip(words, covered(words, least))]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    n = Counter(x[3] for x in s)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s)))


def rules(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, distance=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    each = sorted(set(fps))
    for i, a in enumerate(each):
        for b in each[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    s = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    s += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    s += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    s += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    n = Counter(x[3] for x in s)
    return n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s)))


def targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3.0 * sizes[s] for s in over}
