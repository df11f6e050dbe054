"""Plain versions of the training-data operators, row by row, for the tests."""

import collections
import hashlib
import re

import regex
import xxhash

NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = {
    "assign": (rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]+)", 18),
    "hex": (r"([0-9a-f]+)", 16),
    "key_header": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0),
    "bearer": (r"([Bb]earer\x20+[A-Za-z0-9._~+/-]+=*)", 30),
}


def secrets(text):
    """(start, rule, end, kind) of all spans, by start and then rule."""
    out = []
    for i, (kind, (rule, least)) in enumerate(SECRETS.items()):
        out += [(*m.span(), i, kind) for m in re.finditer(rule, text) if len(m[1]) >= least]
    return sorted((a, i, b, kind) for a, b, i, kind in out)


def secret_digest(text):
    found = secrets(text)
    counts = collections.Counter(k for *_, k in found)
    base = ",".join(f"{k}:{a}:{b}" for a, i, b, k in found if i < 3)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def redacted(text):
    if not text:
        return text
    out, past = [], 0
    for a, _, b, kind in secrets(text):
        if a >= past:
            out += [text[past:a], f"[SECRET:{kind}]"]
        past = max(past, b)
    return "".join(out) + text[past:]


def deleted_lines(docs, least):
    """((key, text), position) of the lines that line dedup deletes, by the definition of the operator."""
    seen = {(k, t) for k, t in docs if t}
    order = sorted(seen, key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) - (xxhash.xxh64_intdigest(x[1].encode(), 42) >> 63 << 64)))
    held = {d: [(i, s) for i, s in enumerate(d[1].split("\n")) if s.split()] for d in order}
    first, match = {}, {}
    for d in order:
        rows = held[d]
        for i in range(len(rows)):
            n, j = 0, i
            while j < len(rows) and n < least:
                n += len(rows[j][1].split())
                j += 1
            if n >= least:
                content = tuple(s for _, s in rows[i:j])
                if content in first:
                    match[d, i] = (j - 1, first[content])
                else:
                    first[content] = (d, i)
    gone = set()
    for d in order:
        rows = held[d]
        starts = sorted(i for e, i in match if e == d)
        covered = {k for i in starts for k in range(i, match[d, i][0] + 1)}
        gone |= {(d, rows[k][0]) for k in covered}
        for k in range(len(rows)):
            if k in covered:
                continue
            for anchor, step in ((max((i for i in starts if i <= k), default=None), -1), (min((i for i in starts if i >= k), default=None), 1)):
                if anchor is None:
                    continue
                (e, at), same, j = match[d, anchor][1], True, k
                while j not in covered:
                    other = j - anchor + at
                    same &= 0 <= other < len(held[e]) and held[e][other][1] == rows[j][1]
                    j += step
                if same:
                    gone.add((d, rows[k][0]))
    return gone


def without_lines(docs, least):
    """The texts of (key, text) rows after line dedup, in their order."""
    gone = deleted_lines(docs, least)
    return [None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if ((k, t), i) not in gone) for k, t in docs]


def fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fingerprint_labels(fps, radius=4):
    """Fingerprint to the smallest one that links lead to."""
    label = {f: f for f in fps}
    for f in label:
        for g in label:
            if (f ^ g).bit_count() <= radius:
                old, new = label[f], label[g]
                label.update({x: min(old, new) for x in label if label[x] in (old, new)})
    return label


def normal(text):
    words = regex.findall(r"\p{L}+", text.lower())
    return f" {' '.join(words)} " if words else ""


def phrases(labelled, text):
    """How many longest matches with substrings of the labelled text a text falls into."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in labelled:
            j += 1
        n, i = n + 1, j
    return n
