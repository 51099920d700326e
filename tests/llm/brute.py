"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def substring_dedup(rows, width=20):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            gram, at = tuple(w[i : i + width]), (key(doc), i)
            first[gram] = min(at, first.get(gram, at))
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (key(doc), i):
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix_dedup(rows, width=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept)."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            gram = raw[i : i + width]
            least[gram] = min(key(doc), least.get(gram, key(doc)))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone, until = bytearray(len(raw)), 0
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < key(doc):
                gone[max(i, until) : i + width] = b"\1" * (i + width - max(i, until))
                until = i + width
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, bytes(c for c, x in zip(raw, gone) if not x)))
    return out


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_components(rows):
    """A number per row that tells its class, and its number of links."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def near_groups(rows):
    """(doc_id, class_id, n_links) per row."""
    roots, links = near_components(rows)
    least = defaultdict(lambda: 1 << 63)
    for root, (doc, _) in zip(roots, rows):
        least[root] = min(least[root], key(doc))
    return [(doc, least[root], n) for root, n, (doc, _) in zip(roots, links, rows)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = words(text)
    n = len(w)
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(repeated) > 30 * n
    lettered = sum(any(c.isalpha() for c in x) for x in w)
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    bad = (
        failed or 100 * symbols > 10 * n or 100 * dup > 50 * len(lines) or 100 * lettered < 50 * n
        or 100 * stutter > 50 * n or chars < 2 * n or chars > 40 * n
    )
    return n, chars, symbols, dup, len(repeated), failed, not bad


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontaminate(rows, items, width=13):
    """(doc_id, n_words, n_hit, items, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - width + 1)) if w else []:
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in rows:
        w, hit, found = item_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out
