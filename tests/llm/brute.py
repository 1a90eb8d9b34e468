"""Plain forms of the operators, for small inputs."""

import collections
import math
import re


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def substring_kept(rows, size=50):
    """Kept words of (id, text) rows; a null id is larger than all."""
    rank = [(math.inf if d is None else d, words(t)) for d, t in rows]
    first = {}
    for d, w in rank:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, math.inf), d)
    out = []
    for d, w in rank:
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                keep[i : i + size] = [False] * size
        out.append([x for x, k in zip(w, keep, strict=True) if k])
    return out


def bag(t):
    w = [x.encode().lower() for x in words(t)]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None


def near_classes(texts, threshold=0.8):
    """The number of each text's class: the place of its first member. Pairs come from shared shingles."""
    bags = [bag(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    holders = collections.defaultdict(list)
    for i, b in enumerate(bags):
        for g in b or ():
            holders[g].append(i)
    seen = set()
    for own in holders.values():
        for i, b in enumerate(own):
            for a in own[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return [find(i) for i in range(len(texts))]


_LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))


def hit_words(text, items):
    """Places of the words inside any phrase of the item texts."""
    phrases = set()
    for t in items:
        w = item_words(t)
        phrases |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(p) for p in phrases}
    w, hit = item_words(text), set()
    for n in sizes:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in phrases:
                hit |= set(range(i, i + n))
    return hit


def auc(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in order[i:j]:
            ranks[k] = (i + j + 1) / 2
        i = j
    pos = sum(labels)
    return (sum(r for r, y in zip(ranks, labels, strict=True) if y) - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))
