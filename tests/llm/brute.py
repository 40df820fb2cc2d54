"""The operators' results once more, by the plainest means and for small inputs only."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def components(nodes, links):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def contaminated(docs, items, window=10):
    by_window = {}
    for number, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            by_window.setdefault(tuple(w[k : k + n]), set()).add(number)
    out = []
    for number, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in by_window}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in by_window:
                    found |= by_window[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((number, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def without_repeats(docs, length=13):
    least = {}
    for number, text in docs:
        w = TOKEN.findall(text or "")
        for k in range(len(w) - length + 1):
            if number is not None:
                g = tuple(w[k : k + length])
                least[g] = min(least.get(g, number), number)
    out = []
    for number, text in docs:
        w, gone = TOKEN.findall(text or ""), set()
        for k in range(len(w) - length + 1):
            if number is not None and least[tuple(w[k : k + length])] < number:
                gone |= set(range(k, k + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((number, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_classes(docs, similarity=0.8, floor=0.1):
    """Class by document id; every pair is compared."""
    sets = []
    for number, text in docs:
        w = words(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
        sets.append((number, Counter(grams)))
    df = Counter(g for _, c in sets for g in c)
    weigh = lambda g: 1 + math.log(1 / max(df[g] / len(docs), floor))
    weighed = [(number, {g: n * weigh(g) for g, n in c.items()}) for number, c in sets if number is not None]
    links = []
    for i, (a, x) in enumerate(weighed):
        for b, y in weighed[:i]:
            shared = sum(min(w, y[g]) for g, w in x.items() if g in y)
            if shared and shared >= similarity * (sum(x.values()) + sum(y.values()) - shared) * (1 - 1e-12):
                links.append((a, b))
    return components({n for n, _ in weighed}, links)


def runs(words, least_words=24, least_exponent=3):
    """Start, length and period of every run, by start and period; every lag and place is tried."""
    out, n = set(), len(words)
    for q in range(1, n // least_exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length, at = at, end + q - at, end
            stretch = words[start : start + length]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(least_words, least_exponent * q) and not smaller:
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def with_block(number, text):
    """The words of a document as the query on periodic runs changes them."""
    words = TOKEN.findall(text or "")
    h = zlib.crc32(str(number).encode())
    g, n = h // 10, len(words)
    if number is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs_row(number, words):
    found = runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (number, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapsed(words, found)))


def collocations(docs, least=10, share=50, most=2000):
    """Rows by language and rank, from all phrases of one to three words."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    rows = []
    for g, a in found.items():
        lang, *w = g
        if any(100 * b >= share * a for h, b in found.items() if len(h) > len(g) and h[0] == lang and w in (list(h[1:3]), list(h[2:4]))):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(w), a, left, right, n[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out, rank = [], Counter()
    for r in rows:
        rank[r[0]] += 1
        if rank[r[0]] <= most:
            out.append((r[0], rank[r[0]], *r[1:]))
    return out
