"""Quality: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from .labelled import keep_scored, labelled_sample, score_documents

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 . , 7 comma, 8 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[46], _KIND[44], _KIND[128:] = 4, 5, 6, 7, 8

NAMES = (
    "log_bytes", "lower", "upper", "digit", "blank", "line_feed", "full_stop", "comma", "symbol", "beyond_ascii",
    "mean_word", "long_words", "distinct_words", "top_word", "lines_log", "mean_line", "distinct_lines",
    "distinct_sentences", "word_ends_symbol", "upper_words", "compressed",
)


def statistics(text: bytes) -> list[float]:
    """NAMES in order, over the whole text; all zero where it is empty."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9)
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    symbol_end = sum(c for x, c in counts.items() if x[-1] in b"!#$%&*|")
    upper = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    lines = [x for x in text.split(b"\n") if x]
    sentences = [x for x in text.replace(b"\n", b" ").split(b". ") if x]
    return [
        np.log1p(n), kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / w, kinds[7] / w,
        kinds[0] / n, kinds[8] / n, lengths.mean(), (lengths > 12).sum() / w, len(counts) / w**0.7,
        max(counts.values(), default=0) / w, np.log1p(len(lines)), w / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)), len(set(sentences)) / max(1, len(sentences)), symbol_end / w, upper / w,
        sum(len(zlib.compress(text[i : i + 65536], 1)) for i in range(0, n, 65536)) / n,
    ]


@dataclass(frozen=True)
class FlatTrees:
    """All trees in arrays: a node's children are at left and left + 1; a leaf has left 0 and itself as its child."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x: all rows step down all trees together, a level at a time."""
        out = np.empty(len(x))
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                inner = self.left[node] > 0
                node = np.where(inner, self.left[node] + (part[row, self.feature[node]] > self.cut[node]), node)
            out[at : at + 2048] = 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(1), -30, 30)))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, smooth: float = 2.0, least: int = 10) -> FlatTrees:
    """Newton boosting on the logistic loss with splits sought in histograms of binned features."""
    y = np.asarray(y, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and y.min() < y.max():
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        z = np.full(len(y), base)
        offsets = np.arange(x.shape[1]) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            open_ = [(len(feature), np.arange(len(y)), 0)]
            feature.append(0), cut.append(0.0), left.append(0), value.append(0.0)
            while open_:
                node, rows, level = open_.pop()
                value[node] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
                split = None
                if level < depth and len(rows) >= 2 * least:
                    spots = (binned[rows] + offsets).ravel()
                    width = x.shape[1] * bins

                    def histogram(v: np.ndarray) -> np.ndarray:
                        weight = np.repeat(v[rows], x.shape[1])
                        return np.bincount(spots, weight, width).reshape(-1, bins).cumsum(1)

                    sg, sh, sn = histogram(g), histogram(h), histogram(np.ones(len(y)))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], len(rows)
                    gain = sg**2 / (sh + smooth) + (tg - sg) ** 2 / (th - sh + smooth) - tg**2 / (th + smooth)
                    gain[(sn < least) | (tn - sn < least)] = 0
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-3 and b < len(edges[f]):
                        split = f, b
                if split is None:
                    z[rows] += value[node]
                    continue
                f, b = split
                feature[node], cut[node], left[node] = int(f), float(edges[f][b]), len(feature)
                goes_right = binned[rows, f] > b
                for side in (rows[~goes_right], rows[goes_right]):
                    open_.append((len(feature), side, level + 1))
                    feature.append(0), cut.append(0.0), left.append(0), value.append(0.0)
    as_ = np.array
    return FlatTrees(as_(roots, np.int64), as_(feature, np.int64), as_(cut, np.float64), as_(left, np.int64), as_(value, np.float64), depth, base)


def quality_scorer(documents: DataFrame, labels: DataFrame, trainable: Column, sample_rows: int = 6000):
    """A function from a list of UTF-8 texts to their scores; see score_quality."""
    texts, y = labelled_sample(documents, labels, "quality", trainable, sample_rows)
    model = fit(np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES)), y)

    def score(batch: list[bytes | None]) -> np.ndarray:
        return model.score(np.array([statistics(t or b"") for t in batch]).reshape(len(batch), len(NAMES)))

    return score


def score_quality(
    documents: DataFrame, labels: DataFrame, trainable: Column, sample_rows: int = 6000, threshold: float = 0.7
) -> DataFrame:
    """Score every whole text; rows of documents for which trainable holds may teach the model.

    documents needs doc_id and text, labels doc_id and quality (0 or 1, null ignored; of several labels for a
    document the largest counts). sample_rows bounds the labelled rows that are used: at most half of it for
    each label, chosen by a hash of doc_id, none longer than labelled.LONGEST bytes. Returns doc_id, score and predicted, one row per row of documents.
    A null or empty text has all statistics zero; without labels every score is 0.5. Other columns are ignored,
    whatever their names. Scoring is one map over the rows without a shuffle.
    """
    return score_documents(documents, quality_scorer(documents, labels, trainable, sample_rows), threshold)


def keep_quality(documents: DataFrame, labels: DataFrame, trainable: Column, sample_rows: int = 6000, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, with all columns, that score threshold or more; the rest as for score_quality."""
    return keep_scored(documents, quality_scorer(documents, labels, trainable, sample_rows), threshold)
