"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\x0c\r"
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), n < 10 or 100 * len(covered) > 20 * n)


def line_dedup(docs, min_chars=20, min_docs=3):
    """docs: (doc_id, text) -> {doc_id: (n_lines, n_dropped, kept)}"""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def base_spans(text):
    text, out = text or "", []
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex").index
    return sorted(out, key=lambda s: (s[1], order(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def top_k(vectors, every=50, k=5):
    """vectors: {vec_id: list of ints} -> sorted (query_id, rank, vec_id, score)"""
    out = []
    for q, v in sorted(vectors.items()):
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), x) for x, w in vectors.items() if x != q and len(w) == len(v)]
            out += [(q, r, x, -s) for r, (s, x) in enumerate(sorted(scores)[:k], 1)]
    return out


def kmers(text, k=5):
    """Labelled k-mers of lower-cased runs of letters and digits, in text order."""
    words = re.findall(r"[^\W_]+", text.lower())
    k, seen, out = min(k, len(words)), Counter(), []
    for i in range(len(words) - k + 1 if words else 0):
        w = tuple(words[i:i + k])
        out.append((w, seen[w]))
        seen[w] += 1
    return out


def aligned(a, b):
    """Length of the longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def near_classes(docs, threshold=0.8):
    """docs: {doc_id: text} -> ({doc_id: smallest id of its class}, linked pairs)"""
    parts = {d: kmers(t or "") for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders, links = defaultdict(list), []
    for d in sorted(docs):
        if parts[d]:
            for m in parts[d]:
                holders[m].append(d)
    for d in sorted(docs):
        common = Counter(x for m in parts[d] for x in holders[m] if x < d)
        for x, n in common.items():
            total = len(parts[d]) + len(parts[x])
            if n / (total - n) >= threshold:
                n = len(parts[d]) if parts[d] == parts[x] else aligned(parts[d], parts[x])
                if n / (total - n) >= threshold:
                    links.append((x, d))
                    a, b = sorted((find(x), find(d)))
                    root[b] = a
    equal = defaultdict(list)
    for d, t in docs.items():
        if not parts[d] and t is not None:
            equal[t].append(d)
    for group in equal.values():
        for d in group:
            root[d] = min(group)
    return {d: find(d) for d in docs}, links
