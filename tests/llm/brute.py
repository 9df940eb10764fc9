"""Plain definitions of the corpus operators, for comparison on small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, k=4):
    w = words((text or "").translate(UPPER))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, threshold=4):
    """Index list -> smallest index reachable over links, for (id, fp) rows."""
    distinct = sorted(set(fp for _, fp in fps))
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for i, fp in fps:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return [(i, fp, least.get(find(fp))) for i, fp in fps]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs, items, window=10):
    """(id, n_words, n_hit, items) per document; ``items`` are (item_id, text)."""
    index = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            index[tuple(w[i : i + n])].add(item)
    lengths = {len(k) for k in index}
    out = []
    for i, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                key = tuple(w[at : at + n])
                if key in index:
                    hit.update(range(at, at + n))
                    found |= index[key]
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return out


def sha_of_items(items):
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def base_quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    t, w = text or "", words(text)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeat), failed


def line_dedup(pages, ratio=0.1, least=5):
    """(host, text) rows -> (text, n_lines, n_dropped)"""
    total, count = Counter(h for h, _ in pages), Counter()
    for h, t in pages:
        count.update({(h, x.strip(SPACE)) for x in (t or "").split("\n") if x.strip(SPACE)})
    out = []
    for h, t in pages:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        kept = []
        for x in lines:
            n = count[(h, x.strip(SPACE))]
            if not (x.strip(SPACE) and n >= least and n * 1_000_000 > total[h] * round(ratio * 1_000_000)):
                kept.append(x)
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def ranked(docs, items, k):
    """(item, rank, doc, score) rows; ``docs`` and ``items`` are (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // length
            s = 0
            for t, times in Counter(split(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def jaccard_groups(docs, percent=85, gram=4):
    sets = []
    for i, text in docs:
        w = words((text or "").translate(UPPER))
        sets.append((i, {tuple(w[j : j + gram]) for j in range(max(len(w) - gram, 0) + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(x), least.get(find(a)) if x else i) for a, (i, x) in enumerate(sets)]


def clusters(vectors, dims=64, k=16, rounds=3):
    """Rows (id, cluster, distance, cluster_inertia, inertia) and the final centroids."""
    fine = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if fine(v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [q for _, q in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres)) for _, q in kept]
        if turn < rounds:
            for n in range(len(centres)):
                own = [q for (_, q), (_, m) in zip(kept, near) if m == n]
                if own:
                    centres[n] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values())) for (i, _), (d, n) in zip(kept, near)], [tuple(c) for c in centres]
