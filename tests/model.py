"""Plain Python forms of the rules, to check the columns against."""

from __future__ import annotations

import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def distance(a: str, b: str) -> int:
    x, y = a.lower().encode(), b.lower().encode()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def like(text: str, needle: str) -> bool:
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle.translate(FOLD))
    return re.search(body, text.translate(FOLD), re.S) is not None


def candidate_key(f):
    return (f["name"].translate(FOLD), f["path"].translate(FOLD), f["line"], f["column"], f["path"], f["name"], f["signature_norm"])


def score(f, name, signature):
    return (distance(f["name"], name) if name else 0) + (distance(f["signature_norm"], signature) if signature else 0)


def rank(functions, name, signature, top):
    def key(f):
        return (score(f, name, signature), f["name"].lower(), f["path"].lower(), f["line"], f["column"], candidate_key(f))

    return sorted(functions, key=key)[: max(0, top)]


def search(functions, name, signature, top, limit):
    def hit(f):
        return bool(
            (not name and not signature)
            or (name and like(f["name"], name))
            or (signature and like(f["signature_norm"], signature))
        )

    ordered = sorted(functions, key=candidate_key)
    found = [f for f in ordered if hit(f)] or ordered
    return rank(found if limit < 0 else found[:limit], name, signature, top)
