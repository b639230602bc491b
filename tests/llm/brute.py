"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring(docs, k=50):
    """op2 on (doc_id, text) with distinct ids."""
    docs = sorted((d, SPACED.findall(t or "")) for d, t in docs)
    first = {}
    for d, w in docs:
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(docs, k=100):
    """op7 on (doc_id, text) with distinct ids."""
    docs = sorted((d, (t or "").encode()) for d, t in docs)
    seen, out = set(), []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            h = b[i : i + k]
            if h in seen:
                gone[i : i + k] = b"\x01" * k
            else:
                seen.add(h)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def classes(docs, n=4, percent=85):
    """op4 on (doc_id, text) with distinct ids; all pairs that share a shingle are compared."""
    sets = {}
    for d, t in docs:
        w = SPACED.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    by = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            by[s].append(d)
    common = defaultdict(int)
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def archive(pages):
    """op6 on (page_id, html) with distinct ids."""
    first, out = {}, []
    for page, html in sorted(pages):
        data = (html or "").encode()
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ref = first.setdefault(data, page)
        out.append((page, len(data), name, "response" if ref == page else "revisit", None if ref == page else ref))
    return out
