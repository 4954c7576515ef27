"""Plain Python versions of the operators, for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    starts = defaultdict(list)
    for i in range(len(w) - 7):
        starts[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in starts.values() if len(at) > 1 for i in at for k in range(8)}
    chars = sum(len(x.decode()) for x in w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def fingerprint(text, size=3):
    import xxhash

    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    """[(doc_id, text)] -> sorted (doc_id, fingerprint, component_id)."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    groups, left = [], set(range(len(prints)))
    while left:
        todo, group = [left.pop()], []
        while todo:
            a = todo.pop()
            group.append(a)
            near = [b for b in left if (prints[a][1] ^ prints[b][1]).bit_count() <= 3]
            left.difference_update(near)
            todo += near
        groups.append(group)
    out = []
    for g in groups:
        least = min((prints[i][0] for i in g if prints[i][0] is not None), default=None)
        out += [(prints[i][0], f"{prints[i][1]:016x}", least) for i in g]
    return sorted(out, key=str)


def recurring(units, window):
    """For each sequence of units the mask of what windows found twice or more cover."""
    n = Counter(tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window] for u in units for i in range(len(u) - window + 1))
    masks = []
    for u in units:
        mask = [False] * len(u)
        end = 0
        for i in range(len(u) - window + 1):
            if n[tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]] > 1:
                for k in range(max(i, end), i + window):
                    mask[k] = True
                end = i + window
        masks.append(mask)
    return masks


def recurring_words(rows, window=35):
    units = [words(t) for _, t in rows]
    return sorted(((i, len(u), sum(m), hashlib.sha256(b" ".join(x for x, g in zip(u, m, strict=True) if not g)).hexdigest()) for (i, _), u, m in zip(rows, units, recurring(units, window), strict=True)), key=str)


def recurring_bytes(rows, window=200):
    units = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), u, m in zip(rows, units, recurring(units, window), strict=True):
        spans = sum(1 for k, g in enumerate(m) if g and (k == 0 or not m[k - 1]))
        out.append((i, len(u), sum(m), spans, hashlib.sha256(bytes(x for x, g in zip(u, m, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: size} -> {source: target}, sharing the excess of capped sources until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    capped, total = set(), Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in capped else share[s] for s in order}
        capped |= above


def top_k(vectors, queries, k=10):
    """[(id, ints)] -> (query, rank, id, score)."""
    out = []
    for q, v in vectors:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in vectors if i != q and len(x) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)
