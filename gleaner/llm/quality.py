"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text is the set of its n-grams (indicators, not counts): words and word pairs, and
one to three consecutive word shapes, where a shape keeps the case, digits and
punctuation of a word and says whether it repeats the word before.  Indicators are
hashed, scaled by the log ratio of their class counts, and a linear hinge-loss model is
fitted to them by dual coordinate descent.  Margins become scores by Platt's sigmoid.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import in_slices
from gleaner.llm.labelled import Sample, labelled_sample

#: Hash space of shape n-grams, then that of words and word pairs.
SHAPES, WORDS = 1 << 14, 1 << 16
REMEMBERED = 300_000
#: Longer runs, as of scripts without spaces, are cut into consecutive words of this length.
LONGEST = 256
_PIECES = re.compile(rf"\S{{1,{LONGEST}}}")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _case(run: re.Match) -> str:
    s = run[0]
    return "X" if s.isupper() else "x" if s.islower() else "Xx" if s[0].isupper() else "xX"


class _Tokens(dict):
    """Word -> hash of its shape * 2^32 + hash of the word."""

    def __missing__(self, word: str) -> int:
        shape = _DIGITS.sub("9", _LETTERS.sub(_case, word))
        code = zlib.crc32(shape.encode("utf-8", "replace")) << 31 | zlib.crc32(word.lower().encode("utf-8", "replace")) >> 1
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[-1]), np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Indicators:
    """Texts to ascending arrays of feature numbers below ``SHAPES + WORDS``."""

    def __init__(self) -> None:
        self.tokens = _Tokens()
        self.flags = np.zeros(SHAPES + WORDS, bool)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if max(map(len, words), default=0) > LONGEST:
            words = _PIECES.findall(text)
        n = len(words)
        codes = np.fromiter(map(self.tokens.__getitem__, words), np.uint64, n)
        word, shape = codes & np.uint64(0x7FFFFFFF), codes >> np.uint64(31)
        if n > 1:
            shape = np.concatenate([shape[:1], np.where(codes[1:] == codes[:-1], np.uint64(1), shape[1:])])
        flags = self.flags
        one = np.uint64(SHAPES - 1)
        flags[(_mix(shape) & one).astype(np.int64)] = True
        for k in (2, 3):
            if n >= k:
                flags[(_mix(*(shape[i : n - k + 1 + i] for i in range(k))) & one).astype(np.int64)] = True
        two = np.uint64(WORDS - 1)
        flags[(_mix(word) & two).astype(np.int64) + SHAPES] = True
        if n > 1:
            flags[(_mix(word[:-1], word[1:]) & two).astype(np.int64) + SHAPES] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found


@dataclass
class QualityModel:
    """``weights`` already hold the log-count ratios; margin = sum(weights[features]) / sqrt(n + 1) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(len(features) + 1) + self.bias)

    def score(self, margin: float | np.ndarray) -> float | np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.offset, -50, 50)))


def _descend(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent (Hsieh et al., 2008) for the L1-loss SVM; classes weigh the same."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    rows = [ratio[f] / np.sqrt(len(f) + 1) for f in features]
    square = np.array([x @ x + 1 for x in rows])
    share = (y == 1).mean()
    limit = np.where(y == 1, cost / (2 * share), cost / (2 * (1 - share)))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, x = features[i], rows[i]
            gradient = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
                w[f] += step * x
                bias += step
        if moved < 1e-4:
            break
    return w, bias


def _platt(margins: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid, by Newton's method on Platt's softened targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        gradient = x.T @ (weights * (p - target)) + 1e-3 * theta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit(sample: Sample, cost: float = 1.0, epochs: int = 20, alpha: float = 1.0) -> QualityModel:
    """Fit on a sample with y in {0, 1}.  With one class only, every score is 1 or 0 for that class; with none, 0.5.

    The features of the sampled texts (a few thousand arrays of at most 2^17 numbers) come to the driver, where the model is fitted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indicators = Indicators()
        for rows in in_slices(batches, "text"):
            yield pd.DataFrame({"y": rows["y"], "f": [indicators(t) for t in rows["text"]]})

    got = sample.rows.select("text", "y", "doc_id").repartition(12, "doc_id").mapInPandas(run, "y int, f array<int>").toPandas()
    size = SHAPES + WORDS
    if got["y"].nunique() < 2:
        only = {0: -30.0, 1: 30.0}.get(got["y"].min() if len(got) else None, 0.0)
        return QualityModel(np.zeros(size), only, 1.0, 0.0)
    features = [np.asarray(f, np.int64) for f in got["f"]]
    positive = got["y"].to_numpy() == 1
    y = np.where(positive, 1, -1)

    def fitted(rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and offset learned from these rows alone, their log-count ratios included."""
        p, q = np.full(size, alpha), np.full(size, alpha)
        for i in rows:
            (p if positive[i] else q)[features[i]] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        w, bias = _descend([features[i] for i in rows], y[rows], ratio, cost, epochs)
        return w * ratio, bias

    weights, bias = fitted(np.arange(len(y)))
    # the sigmoid is fitted on margins of texts that the model behind them has not seen (a quarter of each class)
    apart = np.zeros(len(y), bool)
    for one in (True, False):
        apart[np.flatnonzero(positive == one)[::4]] = True
    rest = np.flatnonzero(~apart)
    held = np.flatnonzero(apart)
    if len(set(y[rest].tolist())) < 2:
        rest = held = np.arange(len(y))
    other = QualityModel(*fitted(rest), 1.0, 0.0)
    margins = np.array([other.margin(features[i]) for i in held])
    rates = {y: sample.counts[y] / sample.taken[y] for y in sample.taken}
    weight = np.where(positive[held], rates.get(1, 1.0), rates.get(0, 1.0))
    slope, offset = _platt(margins, positive[held], weight / weight.mean())
    return QualityModel(weights, bias, slope, offset)


def scorer(model: QualityModel) -> Callable[[Column], Column]:
    """A Column function: text to score (0 to 1); null and empty texts get the score of no features."""
    packed = QualityModel(model.weights.astype(np.float32), model.bias, model.slope, model.offset)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indicators = Indicators()
        for texts in batches:
            margins = [packed.margin(indicators(t or "")) for t in texts]
            yield pd.Series(np.asarray(packed.score(np.array(margins, float)), float))

    return score


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, per_class: int = 3000) -> QualityModel:
    """A model of ``labels.quality``, fitted on at most ``per_class`` documents of each class."""
    return fit(labelled_sample(docs, labels, "quality", per_class, eligible))


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 if score >= 0.5); columns of these names are
    replaced, all others stay.

    Null and empty texts get the score of no features.  Repeated rows are scored each for itself; an empty table gives an
    empty result.  Texts of any length are read whole.
    """
    scored = docs.withColumn("score", scorer(model)(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
