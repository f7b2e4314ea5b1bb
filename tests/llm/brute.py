"""Plain single-machine versions that the operators are compared with."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def repeated_words(docs, window):
    """doc_id -> (n_words, n_removed, sha256 of what stays); docs: (doc_id, text) in order."""
    seen, out = set(), {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeated_bytes(docs, window):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what stays)."""
    seen, out = set(), {}
    for doc_id, text in docs:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 2, bool)
        for i in range(len(body) - window + 1):
            w = body[i : i + window]
            if w in seen:
                gone[i + 1 : i + 1 + window] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        gone = gone[1:-1]
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[doc_id] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids, prints, most=4):
    """id -> smallest id reachable over links of up to ``most`` bits."""
    prints = np.array(prints, np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= most) for p in prints]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label, strict=True)}
        label = new


def rule_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    from collections import Counter

    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)
