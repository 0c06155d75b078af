"""Toxic passages by maximum-scoring segments.

Words and their first letters (stems, for inflected forms) get log-odds of toxic against clean text under an
informative Dirichlet prior (their own frequencies in the training texts together).  A text counts each word once,
so a word that one text repeats is no evidence.  Words whose log-odds are clearly off zero keep a score: a word
scores as itself, else as its longest kept stem, else a small loss.  One linear scan over a document finds all its
maximal scoring segments.  Their scores are made comparable by extreme-value statistics: with rate ``decay``
(lambda) and ``size`` (K) of clean text, a segment of score s in n words is expected K n exp(-lambda s) times by
chance.  Significant segments are added up.  Beside them stands weak evidence, the mean of all words' log-odds,
each shrunk by its own uncertainty and held in a hashed table of fixed size: it ranks texts without a segment, as
with few labels most are.  A logistic curve over these gives the score.

The curve is cross-fitted: the labelled texts are dealt to ``FOLDS`` folds by hash, and each is seen by a model of the
words of the other folds, so that all of them serve the curve and none is judged by words learnt from itself.  The same
rows choose the least |z| of a kept word (the one of ``LEVELS`` whose curve fits best) and the cut: the curve is shifted
so that a half is the cut of highest Matthews correlation.  Rows outside the fit take no part in any of these choices.

The model is fitted on a sample of labelled rows, bounded by ``SAMPLE_ROWS`` and taken by hash of the id; copies of
one text count once.  Words that keep a score are words of that sample.  All else covers every row.

Defined cases: null text counts as empty and has no segment; without labelled rows of both classes every score is
the prior (a half where there is none); repeated rows give a row each; an empty table gives an empty result; null
labels are no labels; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import ascii_lower, materialise, prepare, text_of

#: Most labelled rows of the fit (12 bytes each when broadcast).
SAMPLE_ROWS = 60_000
#: Strength of the prior in words, loss of a word without score, expected chance segments.
PRIOR_WORDS, LOSS, SIGNIFICANT = 2_000.0, 0.05, 0.1
#: Folds of the cross-fit, and what the least |z| of a kept word is chosen from.
FOLDS, LEVELS = 5, (3.0, 3.5, 4.0)
#: Cells of the table of weak evidence, and the |z| at which log-odds are halved there.
WEAK_CELLS, WEAK_Z = 1 << 16, 3.0
#: Letters of a stem, and how many words a worker remembers the scores of.
STEMS, MEMO_WORDS = (4, 8), 200_000
NOT_LETTERS = r"[\x00-\x60\x7B-\x7F]+"
_LETTERS = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of words and of stems (marked by a star), the extreme-value constants of clean text, the curve, weak evidence."""

    scores: dict[str, float]
    decay: float
    size: float
    curve: tuple[float, ...]
    weak: tuple[float, ...] = (0.0,)  # by CRC-32 of a word, modulo the number of cells


def word_score(text: str, scores: dict[str, float]) -> float | None:
    """The score of a word: its own, else that of its longest kept stem."""
    found = scores.get(text)
    if found is None:
        stems = (scores.get(f"{text[:n]}*") for n in range(min(STEMS[1], len(text) - 1), STEMS[0] - 1, -1))
        found = next((x for x in stems if x is not None), None)
    return found


class WordScores(dict):
    """Scores of words in UTF-8, None where there is none; looked up once and remembered within a bound."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__()
        self.scores = scores

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = word_score(word.decode(), self.scores)
        return found


class JointScores(dict):
    """Scores of words in UTF-8 under several models, None where no model has one; remembered within a bound."""

    def __init__(self, models: list[dict[str, float]]) -> None:
        super().__init__()
        self.models = models

    def __missing__(self, word: bytes) -> tuple[float | None, ...] | None:
        text = word.decode()
        found = tuple(word_score(text, m) for m in self.models)
        if all(x is None for x in found):
            found = None
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found
        return found


class WeakScores(dict):
    """Weak evidence of words in UTF-8; looked up once and remembered within a bound."""

    def __init__(self, cells: tuple[float, ...]) -> None:
        super().__init__()
        self.cells = cells

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = self.cells[zlib.crc32(word) % len(self.cells)]
        return out


def maximal_segments(places: list[int], scores: list[float], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) in linear time.

    ``places`` are the word positions with a score of their own; each word between them costs ``loss``.  Segments
    start and end at gains, so the words between can be charged at once.
    """
    # total before, total after, start, stop, and the last segment to the left with a lower total before
    found: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for at, s in zip(places, scores, strict=True):
        total -= loss * (at - last - 1)
        last = at
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = at, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, start, at + 1, j))
    return [(a, b, r - l) for l, r, a, b, _ in found]


def words(text: str) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_LETTERS).split()


def segments_at(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """Maximal scoring segments of a text whose scored words are ``hits`` (position, score)."""
    return maximal_segments([i for i, _ in hits], [x for _, x in hits], LOSS) if hits else []


def mean_weak(all_words: list[bytes], weak: WeakScores) -> float:
    return sum(map(weak.__getitem__, all_words)) / len(all_words) if all_words else 0.0


def with_chance(segments: list[tuple[int, int, float]], n: int, model: ToxicityModel) -> list[tuple[int, int, float, float]]:
    """Segments of a text of ``n`` words with the number that chance would give."""
    return [(a, b, s, model.size * n * math.exp(-model.decay * s)) for a, b, s in segments]


def text_segments(text: str, model: ToxicityModel, scores: WordScores, weak: WeakScores) -> tuple[int, list[tuple[int, int, float, float]], float]:
    """Number of words, the segments with the number expected by chance, and the mean weak evidence."""
    all_words = words(text)
    found = segments_at([(i, s) for i, s in enumerate(map(scores.__getitem__, all_words)) if s is not None])
    return len(all_words), with_chance(found, len(all_words), model), mean_weak(all_words, weak)


def features(n_words: int, segments: list[tuple[int, int, float, float]], weak: float) -> list[float]:
    """What the logistic curve sees: evidence of the best and of all significant segments, its density, and weak evidence."""
    evidence = sorted((max(0.0, -math.log(max(e, 1e-300) / SIGNIFICANT)) for *_, e in segments), reverse=True)
    kept = [x for x in evidence if x > 0]
    best = kept[0] if kept else 0.0
    return [1.0, float(best > 0), math.log1p(best), math.log1p(sum(kept)), math.log1p(sum(kept) / max(n_words, 1) * 100), 10 * weak]


def chance(x: list[float], curve: tuple[float, ...]) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(x, curve, strict=True))))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes with the highest Matthews correlation, of equal ones that nearest to 0; 0 where none parts them."""
    order = np.argsort(-logits, kind="stable")
    found, hits = logits[order], np.cumsum(y[order])
    n, ones = len(y), y.sum()
    above = np.arange(1, n + 1)[:-1]
    hits, gap = hits[:-1], found[:-1] - found[1:]
    spread = above * (n - above) * ones * (n - ones)
    parts = np.where(gap > 1e-9, (hits * n - above * ones) / np.sqrt(np.maximum(spread, 1)), -1.0)
    if not len(parts) or parts.max() <= 0:
        return 0.0
    cuts = ((found[:-1] + found[1:]) / 2)[parts >= parts.max() - 1e-9]
    return float(cuts[np.argmin(np.abs(cuts))])


def curve_of(by_level: list[np.ndarray], y: np.ndarray) -> tuple[int, tuple[float, ...]]:
    """Which level's curve fits cross-fitted rows best (of equal ones the highest), and that curve, cut at a half."""
    curves = [fit_curve(x, y) for x in by_level]
    logits = [np.clip(x @ np.array(w), -35, 35) for x, w in zip(by_level, curves, strict=True)]
    losses = [float(np.logaddexp(0, z).sum() - y @ z) for z in logits]
    level = max(k for k, loss in enumerate(losses) if loss <= min(losses) + 1e-6)
    first, *rest = curves[level]
    return level, (first - best_cut(logits[level], y), *rest)


#: Counts of a word: toxic and clean texts that hold it, and its occurrences in clean ones.
COUNTED = ("t", "c", "n")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, and t, c, n of each fold as t0, c0, n0, t1, ...) over rows (text, toxic 0/1, fold)."""
    split = F.array_remove(F.split(ascii_lower(F.col("text")), NOT_LETTERS), "")
    zero, one, toxic = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("toxic").cast("long")
    # each word once a text, and beside that all occurrences in clean texts: both are counted before anything moves
    once = texts.select("fold", toxic.alias("toxic"), F.explode(F.array_distinct(split)).alias("word")).select("fold", "word", F.col("toxic").alias("t"), (one - F.col("toxic")).alias("c"), zero.alias("n"))
    each = texts.filter("toxic = 0").select("fold", F.explode(split).alias("word")).select("fold", "word", zero.alias("t"), zero.alias("c"), one.alias("n"))
    counted = once.unionByName(each).groupBy("word", "fold").agg(*[F.sum(x).cast("double").alias(x) for x in COUNTED])
    of = lambda x, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(x))), F.lit(0.0)).alias(f"{x}{f}")
    return counted.groupBy("word").agg(*[of(x, f) for f in range(FOLDS) for x in COUNTED])


def left_out(counts: DataFrame, key: str, totals: dict[str, list[float]]) -> DataFrame:
    """(model, key, t, c, n, of_t, of_c): model f < FOLDS leaves fold f out, model FOLDS none; of_ are the model's totals."""

    def counted(x: str, model: int) -> Column:
        return sum((F.col(f"{x}{f}") for f in range(FOLDS) if f != model), F.lit(0.0))

    def total(x: str, model: int) -> float:
        return sum(v for f, v in enumerate(totals[x]) if f != model)

    names = [x for x in COUNTED if f"{x}0" in counts.columns]
    rows = [F.struct(F.lit(m).alias("model"), *[counted(x, m).alias(x) for x in names], F.lit(total("t", m)).alias("of_t"), F.lit(total("c", m)).alias("of_c")) for m in range(FOLDS + 1)]
    return counts.select(key, F.inline(F.array(*rows))).filter(F.col("t") + F.col("c") > 0)


def with_odds(units: DataFrame) -> DataFrame:
    """``units`` (t, c) with log_odds and z under the Dirichlet prior, out of ``of_t`` and ``of_c`` words counted."""
    prior = F.lit(PRIOR_WORDS) * (F.col("t") + F.col("c")) / F.greatest(F.col("of_t") + F.col("of_c"), F.lit(1.0))

    def log_odds(k: Column, n: Column) -> Column:
        return F.log((k + prior) / F.greatest(n + F.lit(PRIOR_WORDS) - k - prior, F.lit(0.5)))

    odds = log_odds(F.col("t"), F.col("of_t")) - log_odds(F.col("c"), F.col("of_c"))
    deviation = F.sqrt(F.try_divide(F.lit(1.0), F.col("t") + prior) + F.try_divide(F.lit(1.0), F.col("c") + prior))
    return units.withColumns({"log_odds": odds, "z": F.try_divide(odds, deviation)})


def word_log_odds(counts: DataFrame, totals: dict[str, list[float]]) -> tuple[DataFrame, DataFrame]:
    """(model, word, clean, log_odds, z) of words and of stems with a star; and (model, cell, log_odds, z) of the cells of weak evidence.

    ``clean`` counts occurrences in clean texts; ``totals`` are the sums of the counts by fold.
    """
    longest = F.least(F.length("word") - 1, F.lit(STEMS[1]))
    names = [f"{x}{f}" for f in range(FOLDS) for x in COUNTED]
    cut = counts.filter(longest >= STEMS[0]).select("word", *names, F.explode(F.sequence(F.lit(STEMS[0]), longest)).alias("k"))
    stems = cut.groupBy(F.concat(F.substring(F.col("word"), F.lit(1), F.col("k")), F.lit("*")).alias("word")).agg(*[F.sum(x).alias(x) for x in names])
    units = with_odds(left_out(counts.select("word", *names).unionByName(stems), "word", totals))
    texts_with = [x for x in names if x[0] != "n"]
    cells = counts.groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(WEAK_CELLS)).cast("int").alias("cell")).agg(*[F.sum(x).alias(x) for x in texts_with])
    return units.select("model", "word", F.col("n").alias("clean"), "log_odds", "z"), with_odds(left_out(cells, "cell", totals)).select("model", "cell", "log_odds", "z")


def clean_shares(clean: dict[str, float], words_in_all: float) -> dict[str, float]:
    """Share of clean words that score as each unit: a stem's words without those of longer units under it."""
    own = dict(clean)
    for unit in clean:
        text = unit.rstrip("*")
        for n in range(min(STEMS[1], len(text) - 1), STEMS[0] - 1, -1):
            if (stem := f"{text[:n]}*") in own:
                own[stem] -= clean[unit]
                break
    return {u: max(c, 0.0) / words_in_all for u, c in own.items()}


def extreme_value_rate(scores: dict[str, float], share: dict[str, float]) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the words of clean text."""
    rest = max(1e-9, 1 - sum(share.values()))

    def excess(rate: float) -> float:
        return rest * math.exp(-rate * LOSS) + sum(p * math.exp(min(600.0, rate * scores[w])) for w, p in share.items()) - 1

    if not any(s > 0 and share.get(w, 0) > 0 for w, s in scores.items()):
        return 1.0
    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def labelled_texts(docs: DataFrame, labels: DataFrame, keep: Column, id_column: str, text_column: str) -> DataFrame:
    """(text, toxic, fold): the bounded sample, each distinct text once, and of texts that share a labelled id one."""
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(keep)
    sample = usable.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(SAMPLE_ROWS)  # a proven bound for both broadcasts
    light = docs.select(F.col(id_column).alias("label_id"), text_of(text_column).alias("text"))
    digests = light.join(F.broadcast(sample), "label_id").groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min("label_id").alias("label_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    )
    chosen = materialise(digests, "sample")
    once = chosen.groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.min("digest").alias("digest"))
    texts = light.join(F.broadcast(once), "label_id").filter(F.sha2("text", 256) == F.col("digest"))
    return texts.select("text", "toxic", F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """Fit on labelled rows; ``keep`` is a condition on ``label_id`` that rows of the fit must meet."""
    prepare(docs.sparkSession)
    texts = labelled_texts(docs, labels, F.lit(True) if keep is None else keep, id_column, text_column)
    return fit_texts(materialise(texts, "labelled"))


def fit_texts(texts: DataFrame) -> ToxicityModel:
    """Fit on rows (text, toxic 0/1, fold).

    Models of words are made for all rows and for all but each fold, at every level, from one count.  Those that
    leave a fold out scan its texts, once for all levels: these heights give a level's size and what the curve sees.
    The model of all rows is the one that scores.
    """
    counts = materialise(word_counts(texts), "word_counts")
    sums = counts.agg(*[F.sum(f"{x}{f}").alias(f"{x}{f}") for f in range(FOLDS) for x in COUNTED]).first()
    totals = {x: [sums[f"{x}{f}"] or 0.0 for f in range(FOLDS)] for x in COUNTED}
    units, cells = word_log_odds(counts, totals)
    weak = np.zeros((FOLDS + 1, WEAK_CELLS))
    cell = cells.toArrow()  # WEAK_CELLS rows a model at most
    z = cell.column("z").to_numpy()
    weak[cell.column("model").to_numpy(), cell.column("cell").to_numpy()] = cell.column("log_odds").to_numpy() * z**2 / (z**2 + WEAK_Z**2)
    rows = units.filter(F.abs("z") >= min(LEVELS)).collect()  # words of the bounded sample
    raw: list[ToxicityModel] = []  # by model, then by level
    for m in range(FOLDS + 1):
        clean_words = max(sum(v for f, v in enumerate(totals["n"]) if f != m), 1)
        for level in LEVELS:
            kept = [r for r in rows if r["model"] == m and abs(r["z"]) >= level]
            scores = {r["word"]: r["log_odds"] for r in kept}
            decay = extreme_value_rate(scores, clean_shares({r["word"]: r["clean"] for r in kept}, clean_words))
            raw.append(ToxicityModel(scores, decay, 1.0, ()))
    words_of, weak_of = (texts.sparkSession.sparkContext.broadcast(x) for x in ([m.scores for m in raw], weak))
    decays, n_levels = [m.decay for m in raw], len(LEVELS)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, light = JointScores(words_of.value), [WeakScores(w) for w in weak_of.value]
        for b in batches:
            lengths, means, heights = [], [], []
            for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                all_words = words(text)
                hits = [(i, s) for i, s in enumerate(map(joint.__getitem__, all_words)) if s is not None]
                lengths.append(len(all_words))
                means.append(mean_weak(all_words, light[fold]))
                own = range(fold * n_levels, (fold + 1) * n_levels)
                heights.append([[decays[k] * s - math.log(len(all_words)) for *_, s in segments_at([(i, x[k]) for i, x in hits if x[k] is not None])] for k in own])
            made = [b.column("toxic"), pa.array(lengths, pa.int64()), pa.array(means, pa.float64()), pa.array(heights, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(made, names=["toxic", "n", "weak", "heights"])

    shown = materialise(texts.select("text", "toxic", "fold").mapInArrow(seen, "toxic int, n long, weak double, heights array<array<double>>"), "heights")
    # the mean of a Gumbel variable is its location plus Euler's constant
    located = shown.filter("toxic = 0").agg(*[F.avg(F.array_max(F.get("heights", F.lit(k)))).alias(f"at{k}") for k in range(n_levels)]).first()
    sizes = [math.exp(min(20.0, at - 0.5772156649)) if at is not None else 1.0 for at in located]

    def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n", "weak", "heights")), strict=True)
            x = [[v for size, high in zip(sizes, levels, strict=True) for v in features(n, [(0, 0, h, size * math.exp(-h)) for h in high], mean)] for n, mean, levels in rows]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = shown.mapInArrow(as_features, "toxic int, x array<double>").toArrow()  # at most SAMPLE_ROWS
    y = found.column("toxic").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        level, curve = curve_of(np.split(np.array(found.column("x").to_pylist()), n_levels, axis=1), y)
    else:
        prior = float(y.mean()) if len(y) else 0.5
        level, curve = n_levels - 1, (math.log((prior + 1e-3) / (1 - prior + 1e-3)), 0.0, 0.0, 0.0, 0.0, 0.0)
    return replace(raw[FOLDS * n_levels + level], size=sizes[level], curve=curve, weak=tuple(weak[FOLDS].tolist()))


def score(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score", segments_column: str | None = "segments") -> DataFrame:
    """``docs`` with a score of 0 to 1, and the significant segments (start and stop in words); rows stay in place.

    Columns of ``docs`` that bear the names of these are replaced.
    """
    docs = docs.drop(score_column, *([segments_column] if segments_column else []))
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)  # words of the bounded sample
    added = [T.StructField(score_column, T.DoubleType())] + ([T.StructField(segments_column, SEGMENTS)] if segments_column else [])
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_column)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        known, light = WordScores(m.scores), WeakScores(m.weak)
        for b in batches:
            found = [text_segments(t or "", m, known, light) for t in b.column(at).to_pylist()]
            columns = [*b.columns, pa.array([chance(features(*f), m.curve) for f in found], pa.float64())]
            if segments_column:
                kept = [[dict(zip(("start", "stop", "score", "expected"), s, strict=True)) for s in seg if s[3] <= SIGNIFICANT] for _, seg, _ in found]
                columns.append(pa.array(kept, kind))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
