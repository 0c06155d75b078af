"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encode(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def exact(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(lower(t), []).append((i, n))
    best = {t: max(g, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for t, g in groups.items()}  # null ids come last
    return sorted(((i, best[lower(t)][0], len(groups[lower(t)]), (i, n) == best[lower(t)], sha(lower(t))) for n, (i, t) in enumerate(rows)), key=repr)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items, width=13):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        found.discard("None")
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = [x for x in (i, least.get(root(k))) if x is not None]
        least[root(k)] = min(known) if known else None
    return sorted(((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def secrets(rows):
    rules = {
        "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    out = []
    for i, t in rows:
        spans = []
        for nth, (kind, p) in enumerate(rules.items()):
            for m in re.finditer(p, t or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                    spans.append((m.start(), nth, kind, m.end()))
        spans.sort()
        n = Counter(s[2] for s in spans)
        out.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))))
    return sorted(out, key=repr)


def base_scores(rows):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in split.items()}


class ToxicWords:
    """Word scores, extreme-value constants and weak evidence from their definition, over (text, toxic)."""

    LOSS, PRIOR, CHANCE = 0.05, 2000.0, 0.1

    def __init__(self, texts, least_z):
        train = [(self.words(t), y) for t, y in texts]
        count = {y: Counter(w for ws, v in train if v == y for w in set(ws)) for y in (0, 1)}
        seen = Counter(w for ws, y in train if not y for w in ws)
        n = {y: sum(c.values()) for y, c in count.items()}
        stem = lambda c: c + Counter()
        unit = {y: stem(c) for y, c in count.items()}
        clean = Counter(seen)
        for w in set(count[0]) | set(count[1]):
            for k in range(4, min(8, len(w) - 1) + 1):
                for y in (0, 1):
                    unit[y][w[:k] + "*"] += count[y][w]
                clean[w[:k] + "*"] += seen[w]

        def odds(t, c):
            p = self.PRIOR * (t + c) / max(n[0] + n[1], 1)
            of = lambda k, m: math.log((k + p) / max(m + self.PRIOR - k - p, 0.5))
            o = of(t, n[1]) - of(c, n[0])
            return o, o / math.sqrt(1 / (t + p) + 1 / (c + p))

        every = {u: odds(unit[1][u], unit[0][u]) for u in set(unit[0]) | set(unit[1]) if unit[0][u] + unit[1][u]}
        self.scores = {u: o for u, (o, z) in every.items() if abs(z) >= least_z}
        cells = {y: Counter() for y in (0, 1)}
        for y in (0, 1):
            for w, k in count[y].items():
                cells[y][zlib.crc32(w.encode()) % 65536] += k
        self.weak = {}
        for cell in set(cells[0]) | set(cells[1]):
            o, z = odds(cells[1][cell], cells[0][cell])
            self.weak[cell] = o * z * z / (z * z + 9)
        # words of clean text by what they score as
        share, total = Counter(), max(sum(seen.values()), 1)
        for w, k in seen.items():
            if (u := self.unit(w)) is not None:
                share[u] += k / total
        self.decay = 1.0
        if any(self.scores[u] > 0 and s > 0 for u, s in share.items()):
            rest = max(1e-9, 1 - sum(share.values()))
            f = lambda x: rest * math.exp(-x * self.LOSS) + sum(s * math.exp(min(600, x * self.scores[u])) for u, s in share.items()) - 1
            lo, hi = 1e-9, 64.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
            self.decay = max(hi, 0.05)
        self.size = 1.0

    @staticmethod
    def words(text):
        return [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", lower(text)) if w]

    def unit(self, w):
        return next((u for u in [w, *(w[:k] + "*" for k in range(min(8, len(w) - 1), 3, -1))] if u in self.scores), None)

    def segments(self, ws):
        """Maximal scoring segments by their definition: the best one, and those beside it."""
        s = [self.scores[u] if (u := self.unit(w)) is not None else -self.LOSS for w in ws]
        out, todo = [], [(0, len(s))]
        while todo:
            lo, hi = todo.pop()
            best, total, start = None, 0.0, lo
            for i in range(lo, hi):
                if total <= 0:
                    total, start = 0.0, i
                total += s[i]
                if best is None or total > best[2] + 1e-12:
                    best = (start, i + 1, total)
            if best and best[2] > 0:
                out.append(best)
                todo += [(lo, best[0]), (best[1], hi)]
        return out

    def features(self, text):
        ws = self.words(text)
        e = [max(0.0, -math.log(max(self.size * len(ws) * math.exp(-self.decay * s), 1e-300) / self.CHANCE)) for _, _, s in self.segments(ws)]
        best, total = max(e, default=0.0), sum(e)
        weak = sum(self.weak.get(zlib.crc32(w.encode()) % 65536, 0.0) for w in ws) / len(ws) if ws else 0.0
        return [1.0, float(best > 0), math.log1p(best), math.log1p(total), math.log1p(total / max(len(ws), 1) * 100), 10 * weak]


class ToxicModel:
    """The toxicity score from its definition, over (text, toxic, fold) of the labelled sample: cross-fitted curve, level and cut."""

    def __init__(self, sample):
        import numpy as np

        y = np.array([y for _, y, _ in sample], float)
        levels = (3.0, 3.5, 4.0)
        folds = {f for *_, f in sample}
        every = {z: {f: ToxicWords([(t, v) for t, v, g in sample if g != f], z) for f in folds} for z in levels}
        size = {}
        for z, of in every.items():
            tops = [of[f].decay * max(s for *_, s in seg) - math.log(len(ws)) for t, v, f in sample if not v and (seg := of[f].segments(ws := of[f].words(t)))]
            size[z] = math.exp(min(20.0, sum(tops) / len(tops) - 0.5772156649)) if tops else 1.0
            for m in of.values():
                m.size = size[z]
        if not 0 < y.sum() < len(y):
            prior = y.mean() if len(y) else 0.5
            self.of = ToxicWords([(t, v) for t, v, _ in sample], levels[-1])
            self.of.size, self.curve = size[levels[-1]], np.array([math.log((prior + 1e-3) / (1 - prior + 1e-3)), 0, 0, 0, 0, 0])
            return
        best = None
        for z in levels:
            x, w = np.array([every[z][f].features(t) for t, _, f in sample]), np.zeros(6)
            loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.005 * w @ w  # noqa: B023, E731
            slope = lambda w: x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.01 * w  # noqa: B023, E731
            for _ in range(200):  # Newton's method with a halved step where it overshoots
                p = 1 / (1 + np.exp(-x @ w))
                step, by = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.01 * np.eye(6), slope(w)), 1.0
                while loss(w - by * step) > loss(w) + 1e-12 and by > 1e-6:
                    by /= 2
                w = w - by * step
            fit = loss(w) - 0.005 * w @ w
            if best is None or fit <= best[0] + 1e-6:
                best = (fit, z, w, x @ w)
        _, z, w, logits = best
        self.of, self.curve = ToxicWords([(t, v) for t, v, _ in sample], z), w.copy()
        self.of.size = size[z]
        cuts, known = [], sorted(logits)
        for a, b in zip(known, known[1:], strict=False):
            if b - a > 1e-9:
                cut = (a + b) / 2
                above = logits > cut
                cuts.append((-round(float(np.corrcoef(above, y)[0, 1]), 8), abs(cut), cut))
        if cuts and min(cuts)[0] < 0:
            self.curve[0] -= min(cuts)[2]

    def score(self, text):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(sum(a * b for a, b in zip(self.of.features(text), self.curve, strict=True)))))))
