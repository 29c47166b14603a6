"""Plain Python counterparts of the corpus operators."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_duplicates(texts, size):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, union_find(sets, pairs)


def rule_counts(text):
    w = WORD.findall(text)
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def unigram(texts):
    """(base score, tokens, known) of every text, and the training tokens."""
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    counts = Counter(t for i, ts in tokens.items() if not held_out(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    return {i: (sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), len(ts), sum(counts[t] > 0 for t in ts)) for i, ts in tokens.items()}, n


def merkle(rows, replace):
    """rows (doc_id, source, lang, n_chars, text): their (leaf, subroot, root, proof_sha256, folded_root, verified), in order."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf_of(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
            out.append(nodes)
        return out

    def path(tree, i):
        out = []
        for nodes in tree[:-1]:
            start = i // 16 * 16
            out.append((i - start, nodes[start:start + 16]))
            i //= 16
        return out

    leaf, by, trees, out = [leaf_of(r) for r in rows], {}, {}, {}
    for k, r in enumerate(rows):
        by.setdefault(r[1], []).append(k)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        trees[s] = levels([leaf[k] for k in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    for j, s in enumerate(order):
        for i, k in enumerate(by[s]):
            way = path(trees[s], i) + path(top, j)
            fold = leaf_of(replace(rows[k]))
            for slot, run in way:
                fold = h(*run[:slot], fold, *run[slot + 1:])
            others = h(*[x for slot, run in way for n, x in enumerate(run) if n != slot])
            out[k] = (leaf[k], trees[s][-1][0], top[-1][0], others, fold, fold == top[-1][0])
    return [out[k] for k in range(len(rows))]


def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (vec_id, vector, label), all of one width: (vec_id, code, error, label_error, codebooks_sha256) of the kept ones, comparing everything."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(scale * float(v)) for v in r[1]] for r in kept], dtype=object).reshape(len(kept), parts, -1)
    first = sorted((i for i in range(len(kept)) if kept[i][0] is not None), key=lambda i: (kept[i][0], kept[i][1]))[:entries]
    book = [x[first, p].copy() for p in range(parts)]

    def nearest():
        return [((x[:, p, None] - book[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)]

    for _ in range(rounds):
        for p, a in enumerate(nearest()):
            for e in range(len(first)):
                if (a == e).any():
                    book[p][e] = x[a == e, p].sum(axis=0) // int((a == e).sum())
    last = nearest()
    error = [int(sum(((x[i, p] - book[p][last[p][i]]) ** 2).sum() for p in range(parts))) for i in range(len(kept))]
    total = Counter()
    for r, e in zip(kept, error, strict=True):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in book for entry in b.tolist() for v in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{int(a[i]):02x}" for a in last), error[i], total[r[2]], digest) for i, r in enumerate(kept)]
