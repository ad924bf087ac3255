"""Documents with everything that can be odd about a row, and brute-force versions of the operators."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, mean double, row_key int, kept string, n int"


def awkward():
    run = " ".join(f"w{i}" for i in range(60))
    other = "\n".join(" ".join(f"v{k}x{i}" for i in range(12)) for k in range(8))
    texts = [
        (1, run), (2, run), (3, f"head {run} tail"), (4, None), (5, ""), (6, " \n\t "), (7, "a"), (8, "a"), (None, run), (None, None), (9, other), (10, other + "\nown line of this text"),
        (11, "x" * 3000), (12, "x" * 3000), (13, "é日本 ß　İ " * 50), (14, "same same same same " * 40), (14, "same same same same " * 40), (15, "\0control\x1c\x85 text"), (16, "<|endoftext|>" + run[:100]),
        (17, other.upper()), (18, "### $$$ %%% " * 60), (-3, run + "\n" + run), (19, "\n\n\n"), (20, "A\r\nB\r\nC"),
    ]
    langs, sources = ("en", None, "de"), ("s1", None, "s2", "s1", "s1")
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t), k, "x", 1.5, k, "y", 3) for k, (i, t) in enumerate(texts)]


def words(text):
    return (text or "").encode().split()


def repeated(seqs, width):
    """For each sequence the places covered by a window of width items that starts elsewhere too."""
    seen = Counter(bytes(s[k : k + width]) if isinstance(s, bytes) else tuple(s[k : k + width]) for s in seqs for k in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if seen[bytes(s[k : k + width]) if isinstance(s, bytes) else tuple(s[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append(gone)
    return out


def components(n, links):
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def jaccard_links(sets, percent):
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
