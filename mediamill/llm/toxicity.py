"""Toxicity by maximum-scoring segments of token log-odds.

*Scores.*  From labelled texts, every unit (a lower-cased word, or the first 4 to 8 bytes of
a longer one) gets the log-odds of its rates in toxic and in other texts under an
informative Dirichlet prior (pseudo-counts in proportion to its rate in both).  Units whose
log-odds, drawn in by :data:`DRAW` standard deviations, are :data:`LEAST_SCORE` or more, lie
:data:`LEAST_Z` deviations above zero and whose rates of texts differ as clearly (a burst in
one text is no evidence) make the lexicon.  Every other word of :data:`LEAST_TEXTS` texts or
more has its own log-odds too, positive or negative, drawn in by one deviation and held
within :data:`WEAK`.

*Search.*  The linear-time scan for all maximal scoring subsequences gives every passage of
a text that can't be made better by lengthening or shortening it.  It runs twice: over the
lexicon's scores for the passages that are reported, and over all tokens' log-odds for the
best segment that a text without lexicon words has.  A small drift is taken off tokens, so
segments end.

*Calibration.*  Best scores of clean texts of ``n`` tokens follow an extreme-value law with
``E = K n exp(-lambda s)``; ``lambda`` solves the moment equation over the clean tokens'
scores and ``K`` is fitted to the clean texts' best scores.  A passage is significant when
its own expectation is below :data:`EXPECT`.  A text's score is a logistic curve, fitted on
the labelled texts, over ``lambda s - ln(K n)``: one curve for texts with words of the
lexicon, and one that stays below a half for the others.

The fit uses at most ``fit_rows`` labelled texts (those with the least hash of their
identifier): a documented bound of the classifier alone.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, lean, written
from .textkit import _BYTE_CODE, _BYTES, ALNUM, LOWER, U64, Words, mix, slices

FIT_ROWS = 12_000
PREFIXES = (8, 7, 6, 5, 4)
PRIOR = 10_000.0
LEAST_Z = 4.0
LEAST_TEXTS = 8
DRAW = 1.64
LEAST_SCORE = 1.5
MOST_UNITS = 50_000
MOST_WORDS = 100_000
DRIFT = 0.03
WEAK = 0.2
WEAK_DRIFT = 0.15
LEAST_SLOPE = 0.1
EXPECT = 0.05
_BITS = 16


def _units(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of each kind of unit and the words that have one."""
    every = np.arange(len(w.hash))
    out = [(w.hash, every)]
    if not len(every):
        return out
    n = len(w.buf)
    up, down = _BYTES.get(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[LOWER[w.buf]] * up[:n], out=run[1:])
    size = w.end - w.start
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        s = w.start[at]
        out.append((mix((run[s + k] - run[s]) * down[s], salt=k), at))
    return out


class Lexicon:
    """Scores of units and words, and the constants of the calibration."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, words: np.ndarray, odds: np.ndarray):
        order, place = np.argsort(hashes), np.argsort(words)
        self.hashes, self.scores = hashes[order], scores[order]
        self.words, self.odds = words[place], odds[place]
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.hashes >> U64(64 - _BITS)).astype(np.int64)] = True
        self.rate, self.k, self.slope, self.bias = 1.0, 1.0, 1.0, 0.0
        self.weak_rate, self.weak_slope, self.weak_bias = 1.0, LEAST_SLOPE, -6.0

    def lexicon_scores(self, w: Words) -> np.ndarray:
        """Each token's score as a unit of the lexicon; 0 where it has none."""
        best = np.zeros(len(w.hash))
        if not len(self.hashes):
            return best
        for h, at in _units(w):
            maybe = np.flatnonzero(self.bits[(h >> U64(64 - _BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            pos = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[pos] == h[maybe]
            tokens = at[maybe[same]]
            best[tokens] = np.maximum(best[tokens], self.scores[pos[same]])
        return best

    def all_scores(self, w: Words, lexicon: np.ndarray) -> np.ndarray:
        """Each token's log-odds less the drift: the lexicon's where there is one, else the word's own."""
        out = np.zeros(len(w.hash))
        if len(self.words) and len(out):
            pos = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
            same = self.words[pos] == w.hash
            out[same] = self.odds[pos[same]]
        return np.where(lexicon > 0, lexicon, out - WEAK_DRIFT)

    def passages(self, w: Words, lexicon: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """Of each text, all maximal scoring segments of lexicon words: first word, number of words, score."""
        rows = len(w.first) - 1
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(rows)]
        up = np.flatnonzero(lexicon > 0)
        if not len(up):
            return found
        run = np.concatenate([[0.0], np.cumsum(np.where(lexicon > 0, lexicon, -DRIFT))])
        owner = np.searchsorted(w.first, up, side="right") - 1
        bounds = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(np.arange(len(up)), bounds):
            r = int(owner[part[0]])
            base = int(w.first[r])
            found[r] = [(a - base, b - a, float(run[b] - run[a])) for a, b in maximal(up[part].tolist(), run)]
        return found

    def best_of_all(self, w: Words, lexicon: np.ndarray) -> np.ndarray:
        """Of each text, the score of its best segment over all tokens' log-odds."""
        run = np.concatenate([[0.0], np.cumsum(self.all_scores(w, lexicon))])
        return np.array([float((run[a : b + 1] - np.minimum.accumulate(run[a : b + 1])).max()) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.rate * best - np.log(self.k * np.maximum(n, 1))

    def weak_evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weak_rate * best - np.log(np.maximum(n, 1))

    def probability(self, best: np.ndarray, weak: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = np.where(best > 0, self.bias + self.slope * self.evidence(best, n), self.weak_bias + self.weak_slope * self.weak_evidence(weak, n))
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        return np.where(best > 0, p, np.minimum(p, 0.49))


def maximal(at: list[int], run: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring subsequences as (first, end), given where scores are positive and running sums of all scores, in linear time.

    Candidates are kept with their left and right sums; a new one joins the candidates back to
    the last whose left sum is smaller, when its right sum is larger than that one's.  Each
    candidate knows the last one before it with a smaller left sum, so a search passes over a
    candidate once and never again.
    """
    first: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []
    for i in at:
        a, low, high = i, float(run[i]), float(run[i + 1])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            a, low = first[j], left[j]
            for kept in (first, end, left, right, back):
                del kept[j:]
        first.append(a)
        end.append(i + 1)
        left.append(low)
        right.append(high)
        back.append(j)
    return list(zip(first, end, strict=True))


@lean("toxicity")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and texts of each unit in toxic and other texts, and the totals under a null unit."""
    for b in batches:
        label = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, buf, off in slices(b.column(1)):
            w = Words(buf, off, ALNUM, True)
            owner = np.repeat(np.arange(hi - lo), w.counts())
            toxic = label[lo:hi][owner] > 0
            hashes, counts, whole = [], [], []
            for kind, (h, at) in enumerate(_units(w)):
                if not len(h):
                    continue
                u, inverse = np.unique(h, return_inverse=True)
                t = toxic[at]
                pair = np.unique(inverse.astype(np.int64) * (hi - lo) + owner[at])
                pu, pt = pair // (hi - lo), label[lo:hi][pair % (hi - lo)] > 0
                hashes.append(u)
                whole.append(np.full(len(u), kind == 0))
                counts.append([np.bincount(x, minlength=len(u)) for x in (inverse[t], inverse[~t], pu[pt], pu[~pt])])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([int(x)], pa.int64()) for x in (toxic.sum(), (~toxic).sum(), 0, 0)], pa.array([False])], ["unit", "t", "c", "dt", "dc", "whole"])
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), *[pa.array(np.concatenate([c[i] for c in counts]).astype(np.int64)) for i in range(4)], pa.array(np.concatenate(whole))], ["unit", "t", "c", "dt", "dc", "whole"])


def _best(lexicon):
    @lean("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for b in batches:
            for lo, hi, buf, off in slices(b.column(1)):
                w = Words(buf, off, ALNUM, True)
                scores = lex.lexicon_scores(w)
                best = [max((s for _, _, s in x), default=0.0) for x in lex.passages(w, scores)]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo), pa.array(w.counts().astype(np.int64)), pa.array(best, pa.float64()), pa.array(lex.best_of_all(w, scores))], ["toxic", "n", "best", "weak"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most ``fit_rows`` labelled texts of those that are not held out.

    Without labelled texts of both kinds the lexicon is empty and every text scores near 0.
    A text is toxic if any of its labels says so; rows that share an identifier are all used;
    null labels, identifiers and texts are passed over.
    """
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    named = labels.select(id_.alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~is_held_out(F.col("id")))
    chosen = named.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = spark.createDataFrame(chosen.collect(), "id long, toxic int")  # at most fit_rows pairs of numbers
    rows = docs.select(id_.alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = written(rows.join(F.broadcast(chosen), "id").where("text is not null").select("id", "text", "toxic"), "labelled")
    counted = sample.mapInArrow(_count, "unit long, t long, c long, dt long, dc long, whole boolean").groupBy("unit").agg(*[F.sum(x).alias(x) for x in ("t", "c", "dt", "dc")], F.max("whole").alias("whole"))
    counted = written(counted, "counts")
    totals = counted.where("unit is null").first()
    if totals is None or not totals.t or not totals.c:
        return _empty()
    nt, nc = float(totals.t), float(totals.c)
    prior = PRIOR * (F.col("t") + F.col("c")) / (nt + nc)
    log_odds = F.log((F.col("t") + prior) / (nt + PRIOR - F.col("t") - prior)) - F.log((F.col("c") + prior) / (nc + PRIOR - F.col("c") - prior))
    spread = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    texts = sample.groupBy("toxic").count().collect()
    ones, others = (float(sum(r["count"] for r in texts if (r.toxic > 0) == y)) for y in (True, False))
    half = F.lit(0.5)
    by_text = F.log((F.col("dt") + half) / (ones - F.col("dt") + half)) - F.log((F.col("dc") + half) / (others - F.col("dc") + half))
    by_text = by_text / F.sqrt(1 / (F.col("dt") + half) + 1 / (F.col("dc") + half) + 1 / (ones - F.col("dt") + half) + 1 / (others - F.col("dc") + half))
    known = counted.where(f"unit is not null and dt + dc >= {LEAST_TEXTS}").withColumns({"d": log_odds, "sd": spread, "z": by_text})
    clear = (F.col("d") >= LEAST_Z * F.col("sd")) & (F.col("z") >= LEAST_Z) & (F.col("d") - DRAW * F.col("sd") >= LEAST_SCORE)
    sure = known.where(clear).orderBy(F.desc(F.col("d") / F.col("sd")), "unit").limit(MOST_UNITS).select("unit", F.col("d") - DRAW * F.col("sd")).collect()
    drawn = F.signum("d") * F.least(F.greatest(F.abs("d") - F.col("sd"), F.lit(0.0)), F.lit(WEAK))
    words = known.where("whole").where(~clear).orderBy(F.desc(F.col("dt") + F.col("dc")), "unit").limit(MOST_WORDS).select("unit", drawn).collect()
    numbers = [(np.array([r[0] for r in x], dtype=np.int64).view(np.uint64), np.array([r[1] for r in x], dtype=float)) for x in (sure, words)]
    lexicon = Lexicon(*numbers[0], *numbers[1])
    _calibrate(lexicon, sample)
    dropped(sample, counted)
    return lexicon


def _empty() -> Lexicon:
    return Lexicon(*[np.zeros(0, np.uint64), np.zeros(0)] * 2)


def _calibrate(lexicon: Lexicon, sample: DataFrame) -> None:
    spark = sample.sparkSession
    held = spark.sparkContext.broadcast(lexicon)
    rows = sample.mapInArrow(_levels(held), "scan string, level double, n long").groupBy("scan", "level").agg(F.sum("n").alias("n")).orderBy("scan", "level").collect()
    rates = []
    for scan in ("all", "lexicon"):
        level, n = (np.array([r[f] for r in rows if r.scan == scan], dtype=float) for f in ("level", "n"))
        rates.append(_rate(level, n / n.sum()) if len(n) else 1.0)
    lexicon.weak_rate, lexicon.rate = rates
    got = np.array([(r.toxic, r.n, r.best, r.weak) for r in sample.mapInArrow(_best(held), "toxic int, n long, best double, weak double").collect()], dtype=float).reshape(-1, 4)
    got = got[got[:, 1] > 0]
    toxic, size, best, weak = got[:, 0] > 0, got[:, 1], got[:, 2], got[:, 3]
    clean = ~toxic & (best > 0)
    # of clean texts of n tokens, 1 - exp(-K n exp(-lambda s)) exceed s; K by the texts that have a score at all
    expected = np.exp(-lexicon.rate * best[clean]) * size[clean]
    share = max(clean.sum(), 1) / max((~toxic).sum(), 1)
    lexicon.k = float(np.clip(share / max(expected.mean(), 1e-9) if clean.any() else 1e-3, 1e-6, 1e3))
    found = best > 0
    if found.any():
        lexicon.slope, lexicon.bias = _logistic(lexicon.evidence(best[found], size[found]), toxic[found].astype(float))
    if (~found).any():
        at = lexicon.weak_evidence(weak[~found], size[~found])
        slope, bias = _logistic(at, toxic[~found].astype(float))
        # more evidence never lowers a score, however few of these texts are toxic
        lexicon.weak_slope = max(slope, LEAST_SLOPE)
        lexicon.weak_bias = bias + (slope - lexicon.weak_slope) * float(at.mean())


def _levels(held):
    """How often clean tokens have each score, in both scans."""

    @lean("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for b in batches:
            label = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in slices(b.column(1)):
                w = Words(buf, off, ALNUM, True)
                clean = np.repeat(label[lo:hi] == 0, w.counts())
                lexicon = lex.lexicon_scores(w)
                for scan, s in (("all", lex.all_scores(w, lexicon)), ("lexicon", np.where(lexicon > 0, lexicon, -DRIFT))):
                    level, n = np.unique(np.round(s[clean], 2), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([scan] * len(n), pa.string()), pa.array(level, pa.float64()), pa.array(n, pa.int64())], ["scan", "level", "n"])

    return run


def _rate(level: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1, by bisection; 1 where there is none."""
    if level.max() <= 0 or (level * p).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * level, 700))).sum()) - 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton's method with a little ridge; classes weigh the same at the start and as they are in the fit."""
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * beta
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / sd), float(beta[1] - beta[0] * mean / sd)


def is_held_out(id_: Column) -> Column:
    """Whether the CRC-32 of the identifier as text is divisible by five; a null identifier is held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' columns but for clashes, with ``score``, ``predicted`` and ``passages`` (first word, words, score, expectation; significant ones) added.

    A null or blank text has no passage and no evidence, and gets the low score of that.  Rows
    are scored each for itself, repeated ones alike.  Columns of ``docs`` named like the new
    ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "passages")]
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))

    @lean("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for b in batches:
            texts = b.column(0).field(text_col).cast(pa.string())
            for lo, hi, buf, off in slices(texts):
                w = Words(buf, off, ALNUM, True)
                scores = lex.lexicon_scores(w)
                found = lex.passages(w, scores)
                n = w.counts()
                best = np.array([max((s for _, _, s in x), default=0.0) for x in found])
                p = lex.probability(best, lex.best_of_all(w, scores), n)
                out = [[{"first": a, "words": c, "score": s, "expect": e} for a, c, s in x if (e := float(np.exp(-lex.evidence(np.array(s), np.array(m))))) < EXPECT] for x, m in zip(found, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array(out, _PASSAGES)], ["row", "score", "passages"])

    kind = f"row {frame.schema['row'].dataType.simpleString()}, score double, passages array<struct<first:int,words:int,score:double,expect:double>>"
    scored = frame.mapInArrow(run, kind)
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


_PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())]))
