"""Plain versions of the operators, and a small table of documents with all odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, low int"


def words(text):
    return SPACED.findall(text or "")


def say(n, seed):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}" for i in range(n))


def odd_documents():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows; two
    columns have names that operators use themselves."""
    passage, base = say(70, 1), say(120, 2)
    texts = {
        1: base, 2: base, 3: base + " more", 4: base.replace("w", "W"), 5: say(60, 3) + " " + passage,
        6: passage + "\n" + say(40, 4), 7: passage, 8: None, 9: "", 10: " \n\t ", 11: "one", 12: "ONE",
        13: "two words", 14: " ".join(["ha"] * 300), 15: "line a b\n" * 30, 16: say(6000, 5),
        17: say(6000, 5) + " " + passage, 18: "Released under the MIT License. " + say(30, 6),
        19: "caf\u00e9 \u65e5\u672c\u8a9e # * $ " + say(30, 7) + " you idiot, you clown",
        20: say(49, 8), 21: say(50, 9), 22: say(50, 9) + " x", 23: "x" * 3000,
        24: "CC-BY-NC and Apache License, Version 2.0 under the MIT license", 25: say(25, 10),
    }
    sources = ["a", "b", None, "\u00e9"]
    rows = [(i, t, "en", sources[i % 4], len(t) if t is not None else None, "x", 1)
            for i, t in texts.items()]
    rows += [rows[20], rows[20]]  # a row three times
    return rows


def quality(text):
    t, w = text or "", words(text)
    seen, again = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if runs[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    return (len(w), sum(map(len, w)), symbols, again, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """Each source's target by its definition: a level so that the capped shares add up to all.
    `sizes` maps sources to words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high = 0.0, float(most * sum(sizes.values()) + 1)
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * sizes[s], level * weigh[s]) for s in names) < sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(most * sizes[s], high * weigh[s]) for s in names}


def toxic(rows, labels):
    """Ids of the rows (id, text) that the words of labelled texts tell to be toxic."""
    def lower(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    verdict = {}
    for i, v in labels:
        if i is not None and v is not None:
            verdict[i] = max(v, verdict.get(i, 0))
    learnt = {i: set() for i in verdict}
    for i, t in rows:
        if i in learnt:
            learnt[i] |= {w[:n] for w in lower(t) for n in (6, 8)}
    bad = Counter(s for i, found in learnt.items() if verdict[i] for s in found)
    good = Counter(s for i, found in learnt.items() if not verdict[i] for s in found)
    marked = {s for s, n in bad.items()
              if n >= 8 and 50 * n >= sum(verdict.values()) and n >= 8 * good[s]}
    hits = [(i, lower(t)) for i, t in rows]
    hits = [(i, w, sum(x[:6] in marked or x[:8] in marked for x in w)) for i, w in hits]
    return {i for i, w, n in hits if n >= 2 and 500 * n >= len(w)}


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest(), rest)
    return out


def licenses(text, phrases, templates, threshold=0.8, block=64):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for k in range(0, max(len(w), 1), block // 2):
        here = set(w[k:k + block])
        for t, label in templates:
            t = set(t.split())
            share = len(here & t) / len(t)
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def katz(rows, discounts, threshold, most):
    """Per id: held out, tokens, known, train tokens, base score, score; and, per history, the sum
    of all words' probabilities."""
    import numpy as np

    tokens = {i: words((t or "").translate(LOWER)) + ["</s>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, _ in rows if not held[i] for w in tokens[i])
    total, size = sum(count.values()), len(count)
    spread = Counter(count.values())
    one = discounts(np.array([spread[r] for r in range(1, 7)]))
    least = threshold(Counter(int(math.log2(c) * 16) for c in count.values()), most)
    chance = {w: (one[c] if c <= 5 else 1) * c / total for w, c in count.items() if c >= least}
    chance["<unk>"] = 1 - sum(chance.values())
    known = lambda w: w if w in chance else "<unk>"
    pairs = Counter()
    for i, _ in rows:
        if not held[i]:
            for h, w in zip(["<s>", *map(known, tokens[i])], map(known, tokens[i])):
                pairs[h, w] += 1
    spread = Counter(pairs.values())
    two = discounts(np.array([spread[r] for r in range(1, 7)]))
    cut = {p: (two[c] if c <= 5 else 1) * c for p, c in pairs.items()}
    sums, kept, seen = Counter(), Counter(), Counter()
    for (h, w), c in pairs.items():
        sums[h] += c
        kept[h] += cut[h, w]
        seen[h] += chance[w]
    plus = {h: 0 if sums[h] - kept[h] > 1e-9 else 1 for h in sums}
    weight = {h: (sums[h] + plus[h] - kept[h]) / (sums[h] + plus[h]) / (1 - seen[h]) for h in sums}

    def p(h, w):
        return (cut[h, w] / (sums[h] + plus[h]) if (h, w) in pairs else weight.get(h, 1) * chance[w])

    out = {}
    for i, _ in rows:
        line = list(map(known, tokens[i]))
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (size + 1))) for w in tokens[i])
        out[i] = (held[i], len(line), sum(count[w] > 0 for w in tokens[i]), total, base,
                  sum(math.log10(p(h, w)) for h, w in zip(["<s>", *line], line)))
    return out, {h: sum(p(h, w) for w in chance) for h in list(sums)[:40]}


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
