"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def components(rows: list[tuple]) -> list[tuple]:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def distinct_sets(rows: list[tuple]) -> dict:
    """Ids of the rows of every distinct set of shingles."""
    sets: dict = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(own, []).append(i)
    return sets


def linked_rows(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(whether the id is null, id, number of linked rows) of every row; (a, b, both, either) of all linked distinct sets."""
    sets = distinct_sets(rows)
    least = lambda ids: None if None in ids else min(ids)
    counts, pairs, names = {s: len(ids) - 1 if s else 0 for s, ids in sets.items()}, [], list(sets)
    for n, s in enumerate(names):
        for t in names[:n]:
            both, either = len(s & t), len(s | t)
            if both and 100 * both >= 75 * either:
                counts[s] += len(sets[t])
                counts[t] += len(sets[s])
                a, b = sorted((least(sets[s]), least(sets[t])), key=lambda i: (i is not None, i or 0))
                pairs.append((a, b, both, either))
    return sorted((i is None, i, counts[s]) for s, ids in sets.items() for i in ids), pairs


def cut(rows: list[tuple], width: int = 100) -> list[tuple]:
    seen, out = set(), []
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if (w := data[s : s + width]) in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def counts(text: str | None) -> tuple:
    text = text or ""
    words, at = WORD.findall(text), collections.defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def katz(rows: list[tuple], top: int = 5) -> dict:
    words, pairs, texts = collections.Counter(), collections.defaultdict(collections.Counter), {}
    for i, t in rows:
        texts[i] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            words.update(texts[i])
            for a, b in zip([None, *texts[i][:-1]], texts[i], strict=True):
                pairs[a][b] += 1
    total, kinds = sum(words.values()), len(words)

    def discount(values) -> dict:
        n = collections.Counter(values)
        last = (top + 1) * n[top + 1] / n[1] if n[1] else 0.0
        out = {}
        for r in range(1, top + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last != 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    du, db = discount(words.values()), discount(c for m in pairs.values() for c in m.values())
    freed = 1 - sum(du.get(c, 1) * c for c in words.values()) / total
    unknown = max(freed, 0.5 / (total + 0.5))

    def lower(w):
        return du.get(words[w], 1) * words[w] / total * (1 - unknown) / (1 - freed) if words[w] else unknown

    models = {}
    for a, m in pairs.items():
        size, room = sum(m.values()), 1 - sum(map(lower, m))
        used = sum(db.get(c, 1) * c for c in m.values()) / size
        left = max(1 - used, 0.5 / (size + 0.5)) if room > 1e-12 else 0
        scale, weight = (1 - left) / used, left / room if room > 1e-12 else 0
        models[a] = ({w: db.get(c, 1) * c / size * scale for w, c in m.items()}, weight)
        whole = sum(models[a][0].values()) + weight * (sum(lower(w) for w in words if w not in m) + unknown)
        assert abs(whole - 1) < 1e-9
    out = {}
    for i, text in texts.items():
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in text)
        score = 0.0
        for a, w in zip([None, *text[:-1]], text, strict=True):
            seen, weight = models.get(a, ({}, 1.0))
            score += math.log10(seen[w] if w in seen else weight * lower(w))
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(text), sum(words[w] > 0 for w in text), total, base, score)
    return out


def katz_of_order(rows: list[tuple], order: int, held: set, top: int = 5) -> dict:
    """Score of each text by a Katz model of any order, with dictionaries of whole contexts."""
    grams: list = [collections.defaultdict(collections.Counter) for _ in range(order)]
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    for i, words in texts:
        if i not in held:
            padded = [None] * (order - 1) + words
            for at in range(order - 1, len(padded)):
                for k in range(order):
                    grams[k][tuple(padded[at - k : at])][padded[at]] += 1
    words = grams[0][()]
    total = sum(words.values())

    def discount(values) -> dict:
        n = collections.Counter(values)
        last = (top + 1) * n[top + 1] / n[1] if n[1] else 0.0
        out = {}
        for r in range(1, top + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last != 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    cut = [discount(c for m in level.values() for c in m.values()) for level in grams]
    freed = 1 - sum(cut[0].get(c, 1) * c for c in words.values()) / total
    unknown = max(freed, 0.5 / (total + 0.5))

    def chance(context: tuple, w) -> float:
        if not context:
            return cut[0].get(words[w], 1) * words[w] / total * (1 - unknown) / (1 - freed) if words[w] else unknown
        m, shorter = grams[len(context)].get(context), context[1:]
        if not m:
            return chance(shorter, w)
        scale, weight = model(context)
        return cut[len(context)].get(m[w], 1) * m[w] / sum(m.values()) * scale if w in m else weight * chance(shorter, w)

    known: dict = {}

    def model(context: tuple) -> tuple:
        if context not in known:
            m = grams[len(context)][context]
            size, room = sum(m.values()), 1 - sum(chance(context[1:], w) for w in m)
            used = sum(cut[len(context)].get(c, 1) * c for c in m.values()) / size
            left = max(1 - used, 0.5 / (size + 0.5)) if room > 1e-12 else 0
            known[context] = (1 - left) / used, left / room if room > 1e-12 else 0
        return known[context]

    for level in grams:
        for context in list(level)[:20]:
            assert abs(sum(chance(context, w) for w in words) + chance(context, "never seen") - 1) < 1e-9
    out = collections.defaultdict(list)
    for i, text in texts:
        padded = [None] * (order - 1) + text
        score = sum(math.log10(chance(tuple(padded[at - order + 1 : at]), padded[at])) for at in range(order - 1, len(padded)))
        out[i].append(score)
    return {i: sorted(v) for i, v in out.items()}
