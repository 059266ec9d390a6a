"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame

from .common import distinct, factors
from .labelled import labelled_sample, score_documents

BUCKETS = 1 << 18
#: Lengths of n-grams taken anywhere in a word, and of those taken only at its start.
ORDERS, STARTS = (3, 4, 5), (6, 7)
#: A gram that occurs so often in a text is a feature more, for each of these.
LEVELS = (2, 4, 8)
FOLDS = 4
BLOCK = 1 << 20
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
_FACTORS = factors(max(ORDERS + STARTS))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Distinct hashed features of a UTF-8 text: its character n-grams, and each with the levels its count reaches.

    Characters are lowered code points, runs of blanks one blank; a blank may start or end a gram, not stand inside it.
    """
    raw = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (raw <= 32) & np.isin(raw, _SPACES)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    raw, blank = raw[keep], blank[keep]
    code = np.where(blank, 32, raw).astype(np.uint64)
    inner = np.cumsum(blank, dtype=np.int32)
    found, total = [], code * _FACTORS[0]
    for n in range(2, max(ORDERS + STARTS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        total = total[:m] + code[n - 1 :] * _FACTORS[n - 1]
        whole = inner[n - 2 : n - 2 + m] == inner[:m]
        if n in ORDERS:
            found.append(total[whole] ^ np.uint64(n))
        elif n in STARTS:
            found.append(total[whole & blank[:m]] ^ np.uint64(n))
    if not found:
        return np.zeros(0, np.int64)
    seen, count = np.unique(np.concatenate(found), return_counts=True)
    features = [seen, *(seen[count >= k] ^ np.uint64(k << 40) for k in LEVELS)]
    return distinct(np.concatenate(features) * _SPREAD >> np.uint64(64 - (buckets.bit_length() - 1))).view(np.int64)


@dataclass(frozen=True)
class NaiveBayesLinear:
    """weights holds, for each bucket, log-count ratio times learned coefficient; slope and shift calibrate the score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        """The linear score of a text's features, before calibration."""
        return float(self.bias + self.weights[found].sum() / _length(len(found))) if len(found) else self.bias

    def score(self, text: bytes) -> float:
        return float(_logistic(self.slope * self.margin(grams(text, len(self.weights))) + self.shift))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _length(n):
    """Divisor for a text of n distinct features: short texts count in full, long ones by a slow power."""
    return np.maximum(n, 50) ** 0.25


def _fitted(rows: list[np.ndarray], y: np.ndarray, buckets: int, rounds: int, penalty: float) -> NaiveBayesLinear:
    """Logistic regression over the ratios by gradient steps with momentum; the same input gives the same model."""
    share = (y.sum() + 1) / (len(y) + 2)
    lengths = np.array([len(r) for r in rows], np.int64)
    if not lengths.sum() or y.min() == y.max():
        return NaiveBayesLinear(np.zeros(buckets), float(np.log(share / (1 - share))))
    counts = np.zeros((2, buckets), np.int64)
    for r, label in zip(rows, y, strict=True):
        counts[int(label), r] += 1  # the features of a row are distinct
    ratio = np.log(((counts[1] + 1) / (y.sum() + 2)) / ((counts[0] + 1) / (len(y) - y.sum() + 2)))
    # a gram that at most two texts hold, or that both classes use alike, says nothing about other texts
    ratio[(counts.sum(0) < 3) | (np.abs(ratio) < 0.3)] = 0
    kept = np.flatnonzero(ratio)
    place = np.full(buckets, -1, np.int32)
    place[kept] = np.arange(len(kept))
    short, scale = [], 1 / _length(lengths)
    for r in rows:
        at = place[r]
        short.append(at[at >= 0])
    ratio = ratio[kept]
    # rows in blocks of about BLOCK features, so that no array of all of them is made
    size = np.array([len(x) for x in short])
    block = np.cumsum(size) // BLOCK
    blocks = []
    for k in np.unique(block):
        of = np.flatnonzero(block == k)
        blocks.append((of, size[of], np.concatenate([short[i] for i in of])))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    weight /= weight.sum()

    # the bias is one more column, so that all have one step size
    def forward(v: np.ndarray) -> np.ndarray:
        out, each = np.full(len(y), v[-1]), v[:-1] * ratio
        for of, n, ids in blocks:
            ends = np.cumsum(n)
            sums = np.append(0.0, np.cumsum(each[ids]))
            out[of] += (sums[ends] - sums[ends - n]) * scale[of]
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kept))
        for of, n, ids in blocks:
            out += np.bincount(ids, np.repeat(e[of] * scale[of], n), len(kept))
        return np.append(out * ratio, e.sum())

    probe = np.ones(len(kept) + 1)
    for _ in range(6):
        probe = back(weight * forward(probe / np.linalg.norm(probe)))
    step = 1 / (0.25 * np.linalg.norm(probe) * 1.1 + penalty)
    start = np.append(np.full(len(kept), 0.02), 0.0)
    coef = ahead = start
    for t in range(rounds):
        slope = back((_logistic(forward(ahead)) - y) * weight) + penalty * (ahead - start)
        new = ahead - step * slope
        coef, ahead = new, new + t / (t + 3) * (new - coef)
    weights = np.zeros(buckets)
    weights[kept] = coef[:-1] * ratio
    return NaiveBayesLinear(weights, float(coef[-1]))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels, by Newton steps; targets are drawn in a little."""
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, at = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _logistic(x @ at)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, x.T @ (p - goal)), -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(texts: list[bytes], labels: np.ndarray, buckets: int = BUCKETS, rounds: int = 100, penalty: float = 1e-4) -> NaiveBayesLinear:
    """A model of all texts, calibrated on the margins that models of the other folds give each fold."""
    rows = [grams(t, buckets).astype(np.int32) for t in texts]
    y = np.asarray(labels, np.float64)
    if not rows:
        return NaiveBayesLinear(np.zeros(buckets), 0.0)
    model = _fitted(rows, y, buckets, rounds, penalty)
    if min(y.sum(), len(y) - y.sum()) < 2 * FOLDS:
        return model
    # each label's rows are dealt out in turn, so that every fold has both
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    z = np.zeros(len(y))
    for k in range(FOLDS):
        one = _fitted([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k], buckets, rounds, penalty)
        z[fold == k] = [one.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    return replace(model, **dict(zip(("slope", "shift"), _calibrated(z, y), strict=True)))


def score_toxicity(
    documents: DataFrame, labels: DataFrame, trainable: Column, sample_rows: int = 4000, threshold: float = 0.7
) -> DataFrame:
    """Score every whole text; rows of documents for which trainable holds may teach the model.

    documents needs doc_id and text, labels doc_id and toxic (0 or 1, null ignored; of several labels for a
    document the largest counts). sample_rows bounds the labelled rows that are used: at most half of it for
    each label, chosen by a hash of doc_id, none longer than labelled.LONGEST bytes. Returns doc_id, score and predicted, one row per row of documents.
    A null or empty text gets the model's score of a text without grams; without labels every score is 0.5.
    Other columns are ignored, whatever their names. Scoring is one map over the rows without a shuffle.
    """
    texts, y = labelled_sample(documents, labels, "toxic", trainable, sample_rows)
    model = fit(texts, y)
    return score_documents(documents, lambda batch: np.array([model.score(t or b"") for t in batch]), threshold)
