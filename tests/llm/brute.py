"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(rows):
    key = lambda line: line.strip(SPACES).translate(UP)
    rank = lambda i: (i is not None, i)
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)], key=rank) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


PATTERNS = (
    ("assign", re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 16),
    ("hex", re.compile("[0-9a-f]+"), 32),
)


def base_spans(text):
    found = []
    for rank, (kind, pattern, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[1] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def shingles(text, k, fold=True):
    w = words(text.translate(UP) if fold and text else text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_groups(rows, k, percent):
    """(id, set size, smallest id reachable) per row, from all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (i, _), s in zip(group, rows, sets):
        if s and i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, len(s), low.get(g, i) if s else i) for (i, _), s, g in zip(rows, sets, group)]


def substrings(rows, n):
    split = [words(t) for _, t in rows]
    count = collections.Counter(tuple(w[j : j + n]) for w in split for j in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for j in range(len(w) - n + 1):
            if count[tuple(w[j : j + n])] > 1:
                gone.update(range(j, j + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out
