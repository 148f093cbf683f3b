"""Plain versions of the operators, by their definitions alone."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, length=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for rows (doc_id, text); a list, since ids may repeat."""
    bodies = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width=5):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(docs):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        common = Counter(j for g in s for j in index[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                parent[root(k)] = root(j)
        for g in s:
            index[g].append(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        if i is not None and (r not in least or least[r] is None or i < least[r]):
            least[r] = i
        least.setdefault(r, i)
    return [(i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def personal(text):
    """Base spans by the patterns as they are stated."""
    text = text or ""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def edited(text, following):
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def features(text):
    """Words and neighbouring pairs of words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, target, least=20, percent=25):
    """[(doc_id, n_features, weight, score, rank)]; rows equal in score and doc_id may swap ranks."""
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def filled(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"
