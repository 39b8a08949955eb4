"""Plain Python versions of the operators."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_components(docs):
    """docs: (id, text). id -> smallest id reachable over links of similarity 0.75."""
    sets = {}
    for i, t in docs:
        sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    pairs = {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_scores(docs):
    """id -> (n_tokens, n_known, train_tokens, base_score)."""
    counts = Counter()
    for i, t in docs:
        if fold(i, 5) != 1:
            counts.update(words(t) + [None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        ws = words(t) + [None]
        out[i] = (
            len(ws), sum(counts[w] > 0 for w in ws), n,
            sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws),
        )
    return out


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
        best = max(best, *row)
    return best


def greedy_pieces(text, training):
    """Longest-match pieces of text that occur in training; an unknown byte is a piece."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in training:
            end += 1
        n, at = n + 1, end
    return n


def mix_targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> target, dealt again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: float(left * weight[s] / total) for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
            open_.discard(s)
    return out


class KneserNey:
    """Log-likelihood ratios of words after their predecessors, over dictionaries."""

    def __init__(self, texts, toxic, least, stem=8, discount=0.75):
        self.stem, self.discount, self.least = stem, discount, least
        tokens = [plain_words(t) for t in texts]
        self.docs = Counter(w for ws in tokens for w in set(ws))
        follows = Counter((w, c) for w, _, c in {(w, u, c) for ws, c in zip(tokens, toxic) for u, w in zip([None, *ws], ws)})
        self.level, self.back = {}, {}
        self._spell("", {w: w.encode() for w in self.docs}, follows, (0.0, 0.0))
        pairs = Counter((u, w, c) for ws, c in zip(tokens, toxic) for u, w in {*zip(["<s>", *map(self._known, ws)], map(self._known, ws))})
        context = Counter()
        for (u, _, c), n in pairs.items():
            context[u, c] += n
        kept = {(u, w) for u, w, _ in pairs if w != "<rare>" and pairs[u, w, True] + pairs[u, w, False] >= least}
        self.held = {(u, w, c): max(pairs[u, w, c] - discount, 0) / max(context[u, c], 1) for u, w in kept for c in (True, False)}
        self.after = {}
        for u in {u for u, _, _ in pairs} | {"<s>", "<rare>"}:
            for c in (True, False):
                self.after[u, c] = max(1 - sum(self.held[x, w, c] for x, w in kept if x == u), 1e-9)

    def _known(self, w):
        return w if self.docs[w] >= self.least else "<rare>"

    def _spell(self, at, words, follows, path):
        """words: those that begin with the bytes at, which has counts of its own."""
        children = defaultdict(list)
        for w, b in words.items():
            n = len(at)
            children[at + chr(b[n]) if n < min(len(b), self.stem) else ("end", w)].append(w)
        total = [sum(follows[w, c] for w in words) for c in (True, False)]
        held = {}
        for child, ws in children.items():
            if sum(self.docs[w] for w in ws) >= self.least:
                held[child] = [max(sum(follows[w, c] for w in ws) - self.discount, 0) / max(t, 1) for c, t in zip((True, False), total)]
        back = [max(1 - sum(h[k] for h in held.values()), 1e-9) for k in (0, 1)]
        self.back[at] = back
        for child, h in held.items():
            p = tuple(path[k] + math.log(h[k] + back[k] * len(children[child]) / len(words)) for k in (0, 1))
            self.level[child] = p
            if isinstance(child, str):
                self._spell(child, {w: words[w] for w in children[child]}, follows, p)

    def word(self, w):
        """Log probabilities (toxic, ordinary), up to a term that both share."""
        b, at, out = w.encode(), "", tuple(math.log(x) for x in self.back[""])
        while True:
            n = len(at)
            child = at + chr(b[n]) if n < min(len(b), self.stem) else ("end", w)
            if child not in self.level:
                return out
            out = self.level[child]
            if not isinstance(child, str):
                return out
            at, out = child, tuple(x + math.log(y) for x, y in zip(out, self.back[child]))

    def ratios(self, text):
        ws, out = plain_words(text), []
        for u, w in zip(["<s>", *map(self._known, ws)], ws):
            p = [self.after[u, c] * math.exp(x) if (u, c) in self.after else math.exp(x) for c, x in zip((True, False), self.word(w))]
            k = self._known(w)
            if (u, k, True) in self.held:
                p = [self.held[u, k, c] + x for c, x in zip((True, False), p)]
            out.append(math.log(p[0]) - math.log(p[1]))
        return out

    def features(self, text, windows=(1, 4)):
        r = self.ratios(text)
        if not r:
            return [0.0] * (1 + len(windows))
        best = [max(sum(r[max(0, k + 1 - n) : k + 1]) / len(r[max(0, k + 1 - n) : k + 1]) for k in range(len(r))) for n in windows]
        return [sum(r) / len(r), *best]
