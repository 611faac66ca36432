"""Plain versions of the operators, by their definitions."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=13):
    windows = {}
    for item, text in items:
        own = WORD.findall(lower(text))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        own, hit, found = WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if (key := tuple(own[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)
    return out


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not own:
        return 0
    parts = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(prints, bits=3):
    """prints: [(id, fingerprint)]; the smallest id that each reaches."""
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= bits:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in prints}
