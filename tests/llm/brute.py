"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
import re


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated_units(docs, n, units):
    """docs: (id, text). Flags of the units that a run of n which also starts earlier covers, by document."""
    seen, out = set(), []
    for _, text in sorted(docs, key=lambda d: d[0]):
        items = units(text)
        gone = [False] * len(items)
        for i in range(len(items) - n + 1):
            run = tuple(items[i : i + n]) if isinstance(items, list) else items[i : i + n]
            if run in seen:
                gone[i : i + n] = [True] * n
            seen.add(run)
        out.append((items, gone))
    return out


def substring_rows(docs, n=20):
    ids = sorted(d[0] for d in docs)
    rows = []
    for i, (words, gone) in zip(ids, repeated_units(docs, n, split_words), strict=True):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        rows.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def byte_rows(docs, n=100):
    ids = sorted(d[0] for d in docs)
    rows = []
    for i, (data, gone) in zip(ids, repeated_units(docs, n, lambda t: (t or "").encode()), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        rows.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def shingle_set(text, n):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in split_words(text)]
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def component_rows(docs, n=4, percent=85):
    """(id, set size, smallest id reachable), comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = {}
    for k, (_, s) in enumerate(sets):
        shared = {}
        for g in s:
            for other in lists.setdefault(g, []):
                shared[other] = shared.get(other, 0) + 1
            lists[g].append(k)
        for other, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[other][1]) - both):
                parent[find(k)] = find(other)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def kneser_ney(train, texts):
    """(tokens, known, base score, score) of texts by dictionaries."""
    import math
    from collections import Counter, defaultdict

    def tokens(text):
        return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in split_words(text)] + [None]

    words, pairs, total = Counter(), Counter(), Counter()
    for text in train:
        seq = tokens(text)
        words.update(seq)
        for a, b in zip(["", *seq], seq, strict=False):
            pairs[a, b] += 1
            total[a] += 1
    follows = Counter(b for _, b in pairs)
    classes = defaultdict(lambda: [0, 0, 0])
    for (a, _), c in pairs.items():
        classes[a][min(c, 3) - 1] += 1

    def discounts(counter):
        n = [sum(c == k for c in counter.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0), k + 1) for k in range(3)]

    dp, dw = discounts(pairs), discounts(follows)
    of = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]
    rest = sum(of(dw, c) for c in follows.values()) / len(pairs) if pairs else 1.0
    n = sum(words.values())
    for text in texts:
        seq = tokens(text)
        base = score = 0.0
        for a, b in zip(["", *seq], seq, strict=False):
            base += math.log10((words[b] + 1) / (n + len(words) + 1))
            low = (max(follows[b] - of(dw, follows[b]), 0) / len(pairs) if pairs else 0) + rest / (len(words) + 1)
            if total[a]:
                c = pairs[a, b]
                left = sum(d * k for d, k in zip(dp, classes[a], strict=True)) / total[a]
                low = max(c - of(dp, c), 0) / total[a] + left * low
            score += math.log10(low)
        yield len(seq), sum(w in words for w in seq), base, score


def longer_scores(train, texts, order):
    """Interpolated modified Kneser-Ney of an order by dictionaries of tuples."""
    import math
    from collections import Counter, defaultdict

    def cuts_of(n):
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0), k + 1) for k in range(3)]

    tokens = lambda t: [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in split_words(t)] + [None]
    raw = [Counter() for _ in range(order + 1)]
    for text in train:
        seq = ["<", *tokens(text)]
        for k in range(1, order + 1):
            raw[k].update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    counts = [None] * (order + 1)
    counts[order] = raw[order]
    for k in range(1, order):
        counts[k] = Counter(g[1:] for g in raw[k + 1])
        if k > 1:
            counts[k].update({g: c for g, c in raw[k].items() if g[0] == "<"})
    cut, groups = [None], [None]
    for k in range(1, order + 1):
        n = [sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]
        cut.append(cuts_of(n))
        groups.append(defaultdict(list))
        for g, c in counts[k].items():
            groups[k][g[:-1]].append(c)
    words = len(raw[1]) - 1
    off = lambda k, c: cut[k][min(c, 3) - 1] if c else 0

    def p(context, w):
        k = len(context) + 1
        low = p(context[1:], w) if context else 1 / (words + 1)
        seen = groups[k].get(context)
        if not seen:
            return low
        c = counts[k][(*context, w)]
        return (max(c - off(k, c), 0) + sum(off(k, x) for x in seen) * low) / sum(seen)

    for text in texts:
        seq = ["<", *tokens(text)]
        yield sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))


def overlaps(docs, items, masks, stretch=20, share=0.8):
    """(doc index, item id, similarity, place): every window of every text against every window of every item."""
    import math

    split = lambda t: re.split(r"[\W_]+", (t or "").lower())
    span = len(masks[0])
    found = {}
    for item_id, text in items:
        item = [w for w in split(text) if w]
        if not item:
            continue
        own = masks if len(item) >= span else ["1" * len(item)]
        need = min(stretch, len(item))
        seeds = {}
        for m in own:
            for q in range(len(item) - len(m) + 1):
                seeds.setdefault((m, tuple(item[q + i] for i, c in enumerate(m) if c == "1")), []).append(q)
        for d, doc in enumerate(docs):
            words = split(doc)
            hits = set()
            for m in own:
                for p in range(len(words) - len(m) + 1):
                    for q in seeds.get((m, tuple(words[p + i] for i, c in enumerate(m) if c == "1")), ()):
                        hits.add((p - q, q, len(m)))
            for shift, q, n in hits:
                for s in range(max(q + n - need, -shift, 0), min(q, len(item) - need, len(words) - shift - need) + 1):
                    equal = sum(item[i] == words[shift + i] for i in range(s, s + need))
                    if equal >= math.ceil(need * share - 1e-9):
                        best = found.setdefault((d, item_id), [0.0, len(words)])
                        best[0] = max(best[0], equal / need)
                        best[1] = min(best[1], shift + s)
    return found
