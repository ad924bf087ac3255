"""Brute-force versions of whole operators, in plain Python and numpy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from llm.fixtures import words

FLOOR = np.array([0.05, 0.04, 0.15, 0.1])
#: 1 - 1e-6 quantile of chi-square with four degrees of freedom.
CUTOFF = 33.3768


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    w, text = words(text), text or ""
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    covered = {j for i, t in enumerate(tri) if many[t] > 1 for j in range(i, i + 3)}
    lined = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lined) - len(set(lined)), len(covered)


def features(s):
    n, chars = max(s[0], 1), max(s[1], 1)
    return [math.log(chars / n), math.sqrt(min(1, s[2] / chars)), math.asin(math.sqrt(min(1, s[4] / n))), math.sqrt(min(1, s[3] / n))]


def consistency(share, p=4):
    cdf = lambda x, d: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, p) < share else (low, mid)
    return share / cdf(high, p + 2)


def scatter(x, share):
    return (consistency(share) if share < 1 else 1) * np.cov(x.T, bias=True) + np.diag(FLOOR**2)


def distances(x, part, share):
    d = x - part.mean(0)
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter(part, share)), d)


def least_determinant(x, tries=0, seed=1):
    """The half-set of the least determinant: of all there are, or of those that steps from ``tries`` random starts end in."""
    n = len(x)
    h = min(n, (n + 5) // 2)
    if not tries:
        return min((list(c) for c in combinations(range(n), h)), key=lambda c: np.linalg.det(scatter(x[c], h / n)))
    r, best = random.Random(seed), None
    for _ in range(tries):
        part = r.sample(range(n), min(n, 5))
        for _ in range(30):
            part = np.argsort(distances(x, x[part], h / n), kind="stable")[:h]
        det = np.linalg.det(scatter(x[part], h / n))
        if best is None or det < best[0]:
            best = det, part
    return list(best[1])


def quality(docs, min_rows=50):
    """Which of the documents (text, lang, source) stay."""
    stats = [statistics(t) for t, _, _ in docs]
    good = [k for k, s in enumerate(stats) if not (s[0] < 50 or 2 * s[4] > s[0])]
    count = Counter(docs[k][1:] for k in good)
    pooled = Counter()
    for (lang, _), n in count.items():
        pooled[lang] += n if n < min_rows else 0
    groups = {}
    for k in good:
        lang, source = docs[k][1:]
        groups.setdefault((lang, source) if count[lang, source] >= min_rows else lang if pooled[lang] >= min_rows else "all of them", []).append(k)
    kept = [False] * len(docs)
    for rows in groups.values():
        x = np.array([features(stats[k]) for k in rows])
        part = least_determinant(x, 60) if len(x) > 1 else [0]
        d2 = distances(x, x[part], len(part) / len(x)) if len(x) > 1 else np.zeros(1)
        for k, d in zip(rows, d2, strict=True):
            kept[k] = bool(d <= CUTOFF)
    return kept


def lines(docs, min_words=1):
    """Texts of (doc_id, text) without the later copies of repeated line runs, and how many lines went; ids are distinct."""
    first, runs = {}, []
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        own = [x for x in (docs[k][1] or "").split("\n") if x.encode().split()]
        for s in range(len(own)):
            for e in range(s, len(own)):
                if sum(len(x.encode().split()) for x in own[s : e + 1]) >= min_words:
                    runs.append((k, s, e, first.setdefault(tuple(own[s : e + 1]), (k, s)) != (k, s)))
                    if min_words == 1:
                        break  # longer runs cover no other lines
    gone = [set() for _ in docs]
    for k, s, e, later in runs:
        if later:
            gone[k].update(range(s, e + 1))
    out = []
    for (_, text), cut in zip(docs, gone, strict=True):
        if not cut:
            out.append((text, 0))
            continue
        kept, at = [], 0
        for x in text.split("\n"):
            worded = bool(x.encode().split())
            if not (worded and at in cut):
                kept.append((x, worded))
            at += worded
        out.append(("\n".join(x for x, _ in kept) if any(w for _, w in kept) else "", len(cut)))
    return out


def mix(docs, weights=(5, 2, 1), share=1.5, cap=2):
    """How often the mix takes each document (doc_id, text, source); ids are distinct."""
    size = [len(words(t)) for _, t, _ in docs]
    total = Counter()
    for n, (_, _, s) in zip(size, docs, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = share * sum(total.values()) - sum(target.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * total[s]]
        target |= {s: cap * total[s] for s in over} if over else part
        open_ -= set(over) if over else open_
    copies = [0] * len(docs)
    for s in names:
        mine = sorted((int(hashlib.md5(str(docs[k][0]).encode()).hexdigest()[:9], 16), k) for k in range(len(docs)) if docs[k][2] == s)
        passes = int(target[s] // total[s]) if total[s] else 0
        need, upto = target[s] - passes * total[s], 0
        for _, k in mine:
            before, upto = upto, upto + size[k]
            nearer = before <= need and upto - need < need - before
            copies[k] = min(cap, passes + (upto <= need or nearer))
    return copies


def negatives(rows, every, positives=5, count=5):
    """Hard negatives of rows (vec_id, label, vector), all pairs by plain whole numbers."""
    top = 1 << 24
    whole = [(i, lab, [math.floor(min(top, max(-top, 256 * x))) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in whole if i is not None and i % every == 0}
    out = []
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for a, lab, v in anchors:
        met = [(sum(x * y for x, y in zip(v, w, strict=True)), i, m == lab) for i, m, w in whole if i != a and len(w) == len(v)]
        for p, i, _ in sorted((t for t in met if t[2]), key=order)[:positives]:
            inside = sorted((t for t in met if not t[2] and 80 * p <= 100 * t[0] <= 100 * p), key=order)[:count]
            out += [(a, i, k + 1, n, p, s) for k, (s, n, _) in enumerate(inside)]
    return out


def damage(turns):
    out = []
    for c, t, r, x in turns:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        case = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x
        out += [(c, t, "user" if case == 4 else r, x)] * (0 if case == 0 else 2 if case == 3 else 1)
        out += [(c, None, None, None)] if case == 0 else []  # the conversation stays in the result
    return out


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTS = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(initials, faults):
    """(cost, audit) by trying everything that costs no more than deleting all rows."""
    best = (3 * len(initials), "D" * len(initials))
    todo = [(0, 0, "", "")]
    while todo:
        k, cost, state, audit = todo.pop()
        if cost > best[0]:
            continue
        if k == len(initials) and state in ("", "a"):
            best = min(best, (cost, audit))
        todo.append((k, cost + 2, STEPS[state, WANTS[state]], audit + "I"))
        if k < len(initials):
            todo.append((k + 1, cost + 3, state, audit + "D"))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                todo.append((k + 1, cost + 2 + more, STEPS[state, WANTS[state]], audit + "R"))
                if (state, initials[k]) in STEPS:
                    todo.append((k + 1, cost + more, STEPS[state, initials[k]], audit + "K"))
    return best


def repairs(turns):
    """Of rows (conv_id, turn, role, text), a null role standing for a conversation without one: what the operator returns, by a plain table
    over rows and states."""
    full, out = {"u": "user", "a": "assistant"}, {}
    for conv in {t[0] for t in turns}:
        rows = sorted((t[1:] for t in turns if t[0] == conv and t[2] is not None), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.sha256(v[2].encode()).digest()))
        known = [t for t, _, _ in rows if t is not None]
        seen, faults = set(), []
        for _, role, text in rows:
            w = b"".join(text.encode().split()).decode()
            faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in rows]

        def inserted(best):
            for _ in range(4):
                for s, (cost, audit, lines) in list(best.items()):
                    t = STEPS[s, WANTS[s]]
                    best[t] = min(best.get(t, (math.inf,)), (cost + 2, audit + "I", [*lines, full[WANTS[s]] + ":"]))
            return best

        best = {"": (0, "", [])}
        for (_, role, text), fault in zip(rows, faults, strict=True):
            new = {}
            for s, (cost, audit, lines) in inserted(best).items():
                ways = [(s, 3, "D", [])]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    ways.append((STEPS[s, WANTS[s]], 2 + more, "R", [f"{full[WANTS[s]]}:{text}"]))
                    kept = STEPS.get((s, role[:1])) if role else s
                    ways += [(kept, more, "K", [f"{role}:{text}"])] if kept is not None else []
                for t, more, letter, line in ways:
                    new[t] = min(new.get(t, (math.inf,)), (cost + more, audit + letter, lines + line))
            best = new
        cost, audit, lines = min(v for s, v in inserted(best).items() if s in ("", "a"))
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
