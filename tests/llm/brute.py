"""Plain versions of the operators, for comparison on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def fold(key) -> int:
    return zlib.crc32(str(key).encode())


def words(text):
    return BLANK.findall((text or "").translate(LOWER))


def fingerprint(text, width=3):
    w = words(text)
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(texts, bits=3):
    """For each text the index of the first one it is linked to, however indirectly."""
    prints = [fingerprint(t) for t in texts]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return prints, [root(i) for i in range(len(texts))]


def removals(texts, length):
    data = [(t or "").encode() for t in texts]
    met = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if met[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def base_scores(keys, texts):
    """(held out, tokens, known tokens, all training tokens, base score) of every text."""
    tokens = [[*words(t), " "] for t in texts]
    held = [fold(k) % 7 == 2 for k in keys]
    counts = collections.Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
    total = sum(counts.values())
    unit = math.log10(total + len(counts) + 1)
    return [(h, len(ts), sum(counts[w] > 0 for w in ts), total, sum(math.log10(counts[w] + 1) - unit for w in ts))
            for ts, h in zip(tokens, held)]


def contamination(texts, items, size=13):
    """(words, hits, items, contaminated) of every text; items are (id, text)."""
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: cut.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for key, text in items:
        w = split(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(key))
    lengths = {len(x) for x in windows}
    out = []
    for text in texts:
        w, hit, held = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    held |= found
        out.append((len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def nearest(ids, vectors, k):
    """For each vector the nearest others as (id, cosine)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    out = {}
    for i, key in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(scores[i, j], 12), ids[j]))[:k]
        out[key] = [(ids[j], scores[i, j]) for j in order]
    return out


_SECRETS = [
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 16), ("hex", re.compile("([0-9a-f]+)"), 1, 32)]


def secrets(text):
    """(counts by kind, sha256 of the spans) of the text itself, without layers."""
    found = [(m.start(), i, kind, m.end()) for i, (kind, pattern, group, least) in enumerate(_SECRETS)
             for m in pattern.finditer(text or "") if len(m[group]) >= least]
    counts = [sum(x[2] == kind for x in found) for kind, *_ in _SECRETS]
    return (*counts, hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)).encode()).hexdigest())
