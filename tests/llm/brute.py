"""Plain versions of the operators, for small inputs."""

import re
import zlib

import numpy as np
import xxhash


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    """Smallest node reachable, over all pairs."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
