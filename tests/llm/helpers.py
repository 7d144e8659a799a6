"""Plain readings of the contracts, to hold the operators against."""

import re
import zlib

import numpy as np
import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def contamination(text, items, window=10):
    """(n_words, n_hit, ids of items with occurring windows) by looking at every place."""
    words, hit, found = ALNUM.findall(low(text)), set(), set()
    places = {}
    for item_id, item in items:
        own = ALNUM.findall(low(item))
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            places.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).add(item_id)
    for n, windows in places.items():
        for i in range(len(words) - n + 1):
            ids = windows.get(tuple(words[i : i + n]))
            if ids:
                hit.update(range(i, i + n))
                found |= {str(x) for x in ids if x is not None}
    return len(words), len(hit), sorted(found)


def fingerprint(text):
    words = SPACE.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, bits=3):
    """Least id reachable, by comparing all pairs of fingerprints; rows of (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    array = np.array(prints, np.uint64)
    label = {f: f for f in prints}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for f in prints:
        for g in array[np.bitwise_count(array ^ np.uint64(f)) <= bits].tolist():
            a, b = root(f), root(g)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, f in rows:
        r = root(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return {(i, f): least.get(root(f)) for i, f in rows}
