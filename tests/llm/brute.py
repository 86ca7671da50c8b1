"""Plain versions of the text operators for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, n):
    found = WORD.findall(lower(text or ""))
    if not found:
        return set()
    return {tuple(found[i:i + n]) for i in range(max(1, len(found) - n + 1))}


def jaccard_components(rows, n=4, percent=85):
    """rows (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_token = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for t in s:
            by_token[t].append(i)
    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for t in s:
            for j in by_token[t]:
                shared[j] += 1
        for j, o in shared.items():
            if j < i and 100 * o >= percent * (len(s) + len(sets[j][1]) - o):
                a, b = top(d), top(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), top(d)) for d, s in sets)


def suffix_dedup(rows, length=50):
    """rows (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(d, first.get(s, d))
    result = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        result.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result)


def substring_distance(item, text):
    """Smallest edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (c != t)))
        row = now
    return min(row)
