"""The operators once more, plainly and slowly, over Python lists of (doc_id, text)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def fingerprint(text):
    w = [x.decode() for x in WORD.findall((text or "").encode())]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows):
    """[(doc_id, fingerprint, component_id)] by all pairs."""
    fps = [(d, fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    least = defaultdict(list)
    for d, f in fps:
        if d is not None:
            least[top(f)].append(d)
    return [(d, f, min(least[top(f)], default=None)) for d, f in fps]


def line_dedup(rows):
    """{(doc_id, text): text left} by a dictionary of windows in (doc_id, text version, line) order."""
    from codestrata.llm.linededup import strip_lines

    def version(t):
        v = xxhash.xxh64_intdigest(t.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (key(r[0]), version(r[1]))):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone.update((i, i + 1, i + 2))
            seen.setdefault(w, (d, i))
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        starts = [i for i in range(len(lines) - 2) if seen.get(tuple(lines[i:i + 3]), (d, i)) != (d, i)]
        assert strip_lines(t, starts) == out[d, t]
    return out


def schedule(blocks, weights):
    """Earliest deadline first, slot by slot, with the windows of each round: [(source, its block)]."""
    out, done, turn = [], [0] * len(blocks), 0
    while any(d < b for d, b in zip(done, blocks)):
        b = [max(0, min(w, n - turn * w)) for w, n in zip(weights, blocks)]
        n, mine = sum(b), [0] * len(b)
        for t in range(n):
            ready = [(-(-(k + 1) * n // x), i) for i, (k, x) in enumerate(zip(mine, b)) if k < x and k * n // x <= t]
            _, i = min(ready)
            out.append((i, done[i]))
            mine[i] += 1
            done[i] += 1
        turn += 1
    return out


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def repeat_words(w):
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)})


def gear_cuts(data, gear, mean, least):
    h, hits = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(gear[b])) % (1 << 16)
        if h < (1 << 16) // mean and i + 1 < len(data) and data[i + 1] & 0xC0 != 0x80:
            hits.append(i + 1)
    cuts = [x for i, x in enumerate(hits) if not i or x - hits[i - 1] >= least]
    return [*cuts, len(data)] if data else []
