"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams (one to three
letters, white space and other signs folded into one boundary mark).  Each language
has several centroids, found by spherical k-means among a bounded sample of its texts,
so that varieties of a language do not blur into one mean.  The nearest centroid by
cosine names the language; a text farther from it than nearly all the texts it was made
from is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import checkpoint, fresh_name, in_slices

SIZE = 1 << 13
UNKNOWN = "und"
_ROWS = 256
_SLICE = 1 << 20


class Grams:
    """Texts to counts of hashed n-grams; None for texts without a letter."""

    def __init__(self) -> None:
        self.letter = _letters()

    def __call__(self, text: str) -> np.ndarray | None:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        counts, any_letter, before = np.zeros(SIZE), False, np.zeros(1, np.uint64)
        # in slices, so that memory does not grow with the text; each begins with the two signs before it
        for at in range(0, len(codes), _SLICE):
            part = codes[at : at + _SLICE]
            letter = self.letter[part]
            any_letter |= bool(letter.any())
            # one mark (zero) for every run of other signs, and one at either end
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] |= bool(before[-1])
            body = np.where(letter, part, 0)[keep].astype(np.uint64)
            first = at == 0
            if at + _SLICE >= len(codes):
                body = np.append(body, np.uint64(0))
            self._count(counts, np.concatenate((before, body)), len(before) if not first else 0)
            before = np.concatenate((before, body))[-2:]
        return counts if any_letter else None

    @staticmethod
    def _count(counts: np.ndarray, marked: np.ndarray, known: int) -> None:
        """Adds the n-grams that end after the first ``known`` signs."""
        h = np.zeros(len(marked), np.uint64)
        for n in (1, 2, 3):
            h = (h[: len(marked) - n + 1] * np.uint64(0x100000001B3)) ^ (marked[n - 1 :] + np.uint64(n))
            mixed = h[max(0, known - n + 1) :] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)
            counts += np.bincount(mixed.astype(np.int64), minlength=SIZE)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit((np.log1p(counts) * idf).astype(np.float32))


@dataclass
class LanguageModel:
    """Centroids in rows, their languages, and the least cosine that each accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reach: np.ndarray


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's nearest; starts from rows far apart, the same every time."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, np.argmax(x @ c.T, axis=1)


def sample(docs: DataFrame, per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang): at most ``per_lang`` texts of each language, chosen by a hash of the id.

    The rows of common languages are thinned by hash first, so that the window that sets the exact bound sees few
    rows of each.  Common is what has more than a 4096th of all rows, so fewer than 4096 languages are broadcast.
    """
    known = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("id is not null and text is not null and lang is not null")
    enough = int(1.5 * per_lang + 50)
    common = known.count() // 4096
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > max(enough, common))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    thinned = known.join(F.broadcast(counts), "lang", "left").where(F.col("n").isNull() | (hashed * F.col("n") < F.lit(float(enough * (1 << 30)))))
    order = Window.partitionBy("lang").orderBy(hashed, "id")
    return thinned.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang).select("text", "lang")


def train(
    docs: DataFrame, per_lang: int = 1500, clusters: int = 4, keep: float = 0.995, eligible: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Fit on at most ``per_lang`` texts of each language that occurs; ``keep`` of them lie within reach.

    Rows with a null text, language or id teach nothing, nor do texts without letters; from an empty table nothing is
    learned and every text is ``und``.  A language has ``clusters`` centroids, a rare one fewer (one for each 50 of its texts).  The
    model grows with the languages (32 kB for each centroid), not with the rows.
    """
    chosen = sample(docs if eligible is None else docs.where(eligible), per_lang, id_col, text_col, lang_col)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for part in in_slices(batches, "text"):
            told = [grams(text) for text in part["text"]]
            part = part[[c is not None for c in told]]
            at = [np.flatnonzero(c) for c in told if c is not None]
            yield pd.DataFrame({"lang": part["lang"], "spread": part["spread"], "at": at, "n": [c[i] for c, i in zip((c for c in told if c is not None), at, strict=True)]})

    # at most SIZE numbers for each text, however long it is; the texts themselves go no further
    rows = chosen.withColumn("spread", F.xxhash64("text")).mapInPandas(counted, "lang string, spread long, at array<int>, n array<float>")
    rows = checkpoint(rows)
    total = rows.count()
    if not total:
        return LanguageModel(np.zeros(SIZE), np.zeros((0, SIZE), np.float32), [], np.zeros(0))
    df = np.zeros(SIZE)
    for r in rows.select(F.explode("at").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect():  # at most SIZE rows
        df[r["gram"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("spread", kind="stable")  # the same in every run
        x = np.zeros((len(group), SIZE), np.float32)
        for row, at, n in zip(x, group["at"], group["n"], strict=True):
            row[at] = np.log1p(n.astype(float)) * idf[at]
        x = _unit(x)
        c, own = _kmeans(x, min(clusters, -(-len(x) // 50)))
        cosine = np.einsum("ij,ij->i", x, c[own])
        used = [j for j in range(len(c)) if (own == j).any()]
        reach = [float(np.quantile(cosine[own == j], 1 - keep)) for j in used]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "cluster": used, "reach": reach, "v": [c[j] for j in used]})

    found = rows.groupBy("lang").applyInPandas(centroids, "lang string, cluster int, reach double, v array<float>").toPandas()
    found = found.sort_values(["lang", "cluster"])
    return LanguageModel(idf, np.stack(found["v"].to_list()).astype(np.float32), found["lang"].to_list(), found["reach"].to_numpy())


def scorer(model: LanguageModel) -> Callable[[Column], Column]:
    """A Column function: text to struct(lang, score, rejected, margin).

    ``score`` is the cosine to the nearest centroid, ``margin`` its lead over the nearest
    centroid of another language; equal cosines go to the language first by name.  Null
    texts and texts without a letter are ``und`` with score 0, and rejected.
    """

    @pandas_udf("lang string, score double, rejected boolean, margin double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, langs = Grams(), np.array(model.langs, object)
        names = sorted(set(model.langs))
        by_lang = [np.flatnonzero(langs == name) for name in names]
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            rejected, margin = np.ones(len(texts), bool), np.zeros(len(texts))
            for at in range(0, len(texts) if names else 0, _ROWS):
                got = [(i, c) for i, t in enumerate(texts.iloc[at : at + _ROWS], at) if t and (c := grams(t)) is not None]
                if not got:
                    continue
                rows = np.array([i for i, _ in got])
                cosine = np.clip(_vectors(np.stack([c for _, c in got]), model.idf) @ model.centroids.T, 0, 1)
                best = np.stack([cosine[:, own].max(axis=1) for own in by_lang], axis=1)
                pick = best.argmax(axis=1)
                nearest = cosine.argmax(axis=1)
                lang[rows] = np.array(names, object)[pick]
                score[rows] = best.max(axis=1)
                rejected[rows] = score[rows] < model.reach[nearest]
                second = np.sort(best, axis=1)[:, -2] if len(names) > 1 else 0
                margin[rows] = score[rows] - second
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected, "margin": margin})

    return identify


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, rejected and margin; columns of these four names are replaced, all others stay.

    Null texts and texts without a letter are ``und``.  Repeated rows are judged each for itself; an empty table gives an
    empty result.  Texts of any length are read whole, in bounded slices.
    """
    found = fresh_name("found")
    out = docs.withColumn(found, scorer(model)(F.col(text_col).cast("string")))
    for name, field in (("lang_pred", "lang"), ("score", "score"), ("rejected", "rejected"), ("margin", "margin")):
        out = out.withColumn(name, F.col(f"{found}.{field}"))
    return out.drop(found)
