"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are whole words and word prefixes of four to seven letters, kept where a
chi-squared test ties them to either label; everything else in a text counts towards one
background term, so that the cosine sees how dense the telling terms are and not only
which they are.  The examples sit in an inverted index whose postings are cut into
blocks of examples with the largest weight of each term in each block (block-max).  A
query scores the blocks of highest bound first and of the others only those that can
hold one of its ``k`` nearest examples; the neighbours are exact.

The ``k`` nearest sampled documents vote; documents with equal vectors are one example, and those that tie for the last
places share them, so that votes depend neither on ids nor on the order of the labels.  Votes are
weighted by similarity and by how many labelled documents an example stands for, and shrunk towards the share of label 1, which makes the score a calibrated
probability.  The neighbours are returned as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import fresh_name, in_slices
from gleaner.llm.labelled import Sample, labelled_sample

PREFIXES = (4, 5, 6, 7)
REMEMBERED = 300_000
BLOCK = 64
#: Similarities that differ by less are equal: the same sum may round differently.
TIE = 1e-9
#: Longer runs, as of scripts without spaces, are cut into consecutive words.
_WORD = re.compile(r"\w{1,64}")


def _terms(word: str) -> list[str]:
    """The word, and its prefixes marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class _Known(dict):
    """Word -> numbers of its vocabulary terms."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.vocabulary[t] for t in _terms(word) if t in self.vocabulary)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


class Vectors:
    """Texts to unit TF-IDF vectors (term numbers, weights); the last term is the background."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, background: float) -> None:
        self.known, self.idf, self.background = _Known(vocabulary), idf, background

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        counts = Counter(t for found in map(self.known.__getitem__, words) if found for t in found)
        terms = np.array([*sorted(counts), len(self.idf)], np.int64)
        weights = np.array([*(counts[t] * self.idf[t] for t in terms[:-1].tolist()), len(words) * self.background])
        return terms, weights / np.sqrt(weights @ weights)


class BlockMaxIndex:
    """Exact k nearest vectors by inner product of non-negative sparse vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, block: int = BLOCK) -> None:
        # neighbours in number share their heaviest term, which keeps blocks alike and bounds tight
        n = len(vectors)
        self.blocks, self.block = max(1, -(-n // block)), block
        term = np.concatenate([t for t, _ in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.zeros(0)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in vectors]) if n else np.zeros(0, np.int64)
        order = np.lexsort((doc, term))
        term, self.weight, doc = term[order], weight[order], doc[order]
        self.doc = doc
        cell = term * self.blocks + doc // block
        self.start = np.searchsorted(cell, np.arange(size * self.blocks + 1)).astype(np.int64)
        self.highest = np.zeros(size * self.blocks)
        np.maximum.at(self.highest, cell, self.weight)
        self.highest = self.highest.reshape(size, self.blocks)
        self.n = n

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of some blocks with similarity above zero, and their similarities."""
        cells = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        begin = self.start[cells]
        length = self.start[cells + 1] - begin
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        by = np.repeat(np.repeat(weights, len(blocks)), length)
        got = np.bincount(self.doc[at], weights=by * self.weight[at], minlength=self.n)
        hit = np.flatnonzero(got)
        return hit, got[hit]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, ties: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and similarities, best first; only examples with similarity above zero.  With ``ties`` all
        that are as near as the k-th (up to ``TIE``), else k, of equal ones those of smaller number.

        The blocks with the highest bounds that surely hold k examples come first; their k-th
        similarity is a floor, and only blocks whose bound reaches it are scored as well.
        """
        bound = weights @ self.highest[terms]
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        first = -(-2 * k // self.block) + 1
        ids, found = self._scores(terms, weights, order[:first])
        floor = np.partition(found, -k)[-k] if len(found) >= k else 0.0
        rest = order[first:]
        rest = rest[bound[rest] >= floor - TIE]
        if len(rest):
            more, scores = self._scores(terms, weights, rest)
            ids, found = np.concatenate((ids, more)), np.concatenate((found, scores))
        if len(found) > k:
            good = np.flatnonzero(found >= np.partition(found, -k)[-k] - TIE)
            ids, found = ids[good], found[good]
        top = np.lexsort((ids, -found))
        top = top if ties else top[:k]
        return ids[top], found[top]


@dataclass
class ToxicityModel:
    """An example is a vector that one or more sampled documents have: ``ids`` is the smallest of theirs, ``docs`` their
    number, ``weight`` how many labelled documents they stand for, ``toxic`` the share of those with label 1."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    docs: np.ndarray
    prior: float
    background: float = 0.05
    k: int = 15
    power: int = 4
    shrink: float = 0.5

    def shares(self, numbers: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        """How much of each example counts, nearest first: all, until ``k`` documents are reached; those that tie for the
        last places share them alike."""
        if not len(numbers):
            return similarity
        tie = np.concatenate(([0], np.cumsum(similarity[:-1] - similarity[1:] > TIE)))
        size = np.bincount(tie, weights=self.docs[numbers])
        return np.clip((self.k - (np.cumsum(size) - size)) / size, 0, 1)[tie]

    def vote(self, numbers: np.ndarray, similarity: np.ndarray) -> float:
        w = np.minimum(similarity, 1.0) ** self.power * self.weight[numbers] * self.shares(numbers, similarity)
        return float((w @ self.toxic[numbers] + self.shrink * self.prior) / (w.sum() + self.shrink))


def _chosen_terms(sample: Sample, least: int, chi: float, most: int) -> list[tuple[str, int]]:
    """(term, documents) of the terms that lean towards either label by a chi-squared test, strongest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones, zeros = Counter(), Counter()
        for rows in in_slices(batches, "text"):
            for text, y in zip(rows["text"], rows["y"], strict=True):
                (ones if y else zeros).update({t for w in set(_WORD.findall(text.lower())) for t in _terms(w)})
            if len(ones) + len(zeros) > 1_000_000:
                yield frame(ones, zeros)
                ones.clear()
                zeros.clear()
        yield frame(ones, zeros)

    def frame(ones: Counter, zeros: Counter) -> pd.DataFrame:
        terms = list(ones.keys() | zeros.keys())
        return pd.DataFrame({"term": pd.Series(terms, dtype=object), "a": [ones[t] for t in terms], "b": [zeros[t] for t in terms]})

    # each sampled document stands for this many labelled ones
    rate = {y: sample.counts[y] / sample.taken[y] for y in sample.taken}
    n1, n0 = float(sample.taken.get(1, 0)), float(sample.taken.get(0, 0))
    n = n1 + n0
    counted = (
        sample.rows.select("text", "y", "doc_id").repartition(12, "doc_id")
        .mapInPandas(run, "term string, a long, b long")
        .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .withColumn("expected", (F.col("a") + F.col("b")) * n1 / n)
        .where(F.col("a") + F.col("b") >= least)
        .withColumn("chi", F.pow(F.col("a") - F.col("expected"), 2) / F.col("expected") * n / n0)
        .where(F.col("chi") > chi)
        .withColumn("docs", F.col("a") * rate.get(1, 1.0) + F.col("b") * rate.get(0, 1.0))
    )
    return [(r["term"], r["docs"]) for r in counted.orderBy(F.desc("chi"), "term").limit(most).collect()]


def fit(sample: Sample, least: int = 5, chi: float = 15.0, most: int = 4000, **settings) -> ToxicityModel:
    """A model from a sample with y in {0, 1}; ``most`` bounds its vocabulary.

    With labels of one class only there is nothing to compare: every score is that class's
    share (0 or 1); without labels it is 0.
    """
    total = sum(sample.counts.values())
    prior = sample.counts.get(1, 0) / total if total else 0.0
    if min(sample.taken.get(0, 0), sample.taken.get(1, 0)) == 0:
        return ToxicityModel({}, np.zeros(0), [], np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), prior, **settings)
    chosen = _chosen_terms(sample, least, chi, most)
    vocabulary = {t: i for i, (t, _) in enumerate(chosen)}
    idf = np.array([math.log((1 + total) / (1 + d)) + 1 for _, d in chosen])
    background = settings.get("background", ToxicityModel.background)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(vocabulary, idf, background)
        for rows in in_slices(batches, "text"):
            got = [vectors(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "y": rows["y"], "t": [t for t, _ in got], "w": [w for _, w in got]})

    got = sample.rows.mapInPandas(run, "doc_id long, y int, t array<long>, w array<double>").toPandas()
    rate = {y: sample.counts[y] / sample.taken[y] for y in sample.taken}
    # equal vectors are one example, which votes for all its documents
    examples: dict[bytes, list] = {}
    for doc_id, y, t, w in zip(got["doc_id"], got["y"], got["t"], got["w"], strict=True):
        t, w = np.asarray(t, np.int64), np.asarray(w, float)
        own = examples.setdefault(t.tobytes() + np.round(w, 12).tobytes(), [t, w, doc_id, 0.0, 0.0, 0])
        own[2] = min(own[2], doc_id)
        own[3] += rate[y]
        own[4] += rate[y] * y
        own[5] += 1
    # those whose heaviest terms agree stand together; the order does not know the labels
    found = sorted(examples.values(), key=lambda e: (e[0][np.argmax(e[1])] if len(e[0]) else -1, e[2]))
    weight = np.array([e[3] for e in found])
    return ToxicityModel(
        vocabulary, idf, [(e[0], e[1]) for e in found], np.array([e[2] for e in found], np.int64), np.array([e[4] for e in found]) / weight,
        weight / min(rate.values()), np.array([e[5] for e in found], float), prior, **settings,
    )


class _Judge:
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.vectors = Vectors(model.vocabulary, model.idf, model.background)
        self.index = BlockMaxIndex(model.vectors, len(model.idf) + 1)
        self.seen: dict[bytes, tuple] = {}

    def __call__(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        terms, weights = self.vectors(text)
        key = terms.tobytes() + weights.tobytes() if len(terms) < 3 else b""
        if key in self.seen:
            return self.seen[key]
        numbers, similarity = self.index.search(terms, weights, self.model.k, ties=True) if len(terms) else (terms, weights)
        score, used = self.model.vote(numbers, similarity), self.model.shares(numbers, similarity) > 0
        ids, similarity = self.model.ids[numbers[used]], similarity[used]
        shown = np.lexsort((ids, -np.round(similarity, 9)))[: self.model.k]
        out = (score, ids[shown], similarity[shown])
        if key and len(self.seen) < 10_000:
            self.seen[key] = out
        return out


def scorer(model: ToxicityModel) -> Callable[[Column], Column]:
    """A Column function: text to struct(score, evidence array<struct<doc_id, similarity>>).

    Null texts and texts without words have no neighbours and score the share of label 1.
    """

    @pandas_udf("score double, ids array<long>, similarity array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = _Judge(model)
        for texts in batches:
            got = [one(t or "") for t in texts]
            yield pd.DataFrame({"score": [g[0] for g in got], "ids": [g[1] for g in got], "similarity": [g[2] for g in got]})

    return judge


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, per_class: int = 3000) -> ToxicityModel:
    """A model of ``labels.toxic``, fitted on at most ``per_class`` documents of each class."""
    return fit(labelled_sample(docs, labels, "toxic", per_class, eligible))


def classify(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted (1 if score >= 0.5), evidence (nearest examples, best first, at most ``k``)
    and similarity (theirs); columns of these four names are replaced, all others stay.

    Null and empty texts score the share of label 1 and have no evidence.  Repeated rows are scored each for itself; an
    empty table gives an empty result.  Texts of any length are read whole.
    """
    name = fresh_name("judged")
    judged = docs.withColumn(name, scorer(model)(F.col(text_col).cast("string")))
    return (
        judged.withColumn("score", F.col(f"{name}.score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumn("evidence", F.col(f"{name}.ids"))
        .withColumn("similarity", F.col(f"{name}.similarity"))
        .drop(name)
    )
