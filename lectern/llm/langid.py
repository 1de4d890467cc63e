"""Language identification: the nearest of several centroids of each language, by cosine of TF-IDF n-gram vectors.

A text is lower-cased, all that is no letter becomes a space, and its character n-grams of 1 to 3 are hashed into
``BUCKETS`` counts. A vector is those counts, dampened by their square root, times the inverse document frequency,
at unit length. The vectors of each language's training sample are clustered by spherical k-means into a few
centroids. A text takes the language of the centroid with the largest cosine. It is rejected if it is farther from
that centroid than all but a few training texts of about its length are from theirs, with room to spare.

The fit sees at most ``SAMPLE`` rows of each language and ``FIT_ROWS`` in all, those with the smallest hash of id and
text, so that the sample is the same however the rows are spread. Their whole texts are counted where they lie; the driver gets counts
only. Every row is predicted, from its whole text.

Defined results: texts without a letter, and null texts, are ``und`` with score 0, and rejected; with no training
rows all texts are ``und``; an empty table gives an empty result; repeated rows each have a result; ties go to the
language first in the alphabet. Very long texts are counted in pieces. Columns other than those named are not read, so
they may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import prepare, remainder, worker_state

BUCKETS = 1 << 12
SAMPLE = 1500
#: Rows that the fit sees at most in all; with more than FIT_ROWS / SAMPLE languages each has an even share of them.
FIT_ROWS = 30_000
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but QUANTILE of training texts of its length reach.
SLACK, QUANTILE = 0.6, 0.002
#: Upper bounds of letters of the length classes for rejection.
LENGTHS = (20, 50, 150, 500)
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _codes(text: str) -> np.ndarray:
    """Code points, with a space for all that is no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(32))


def counts(text: str) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts of a whole text in lower case with a space at either end, and its number of letters."""
    out = np.zeros(BUCKETS)
    text, letters = f" {text.lower()} ", 0
    for a in range(0, len(text), 1 << 18):  # long texts in overlapping pieces
        part = _codes(text[a : a + (1 << 18) + 2])
        own = len(part) if a + (1 << 18) >= len(text) else 1 << 18
        word = part != 32
        letters += int(word[:own].sum())
        h1 = part * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (part[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        h3 = (h2[:-1] ^ (part[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for h, keep in ((h1, word), (h2, word[:-1] | word[1:]), (h3, word[1:-1])):
            kept = (h >> np.uint32(20))[:own][keep[:own]]
            out += np.bincount(kept, minlength=BUCKETS)
    return out, letters


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    owner: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score 0 to 1, rejected) of each text."""
        rows, letters = np.zeros((len(texts), BUCKETS), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                c, letters[i] = counts(t)
                rows[i] = c
        if not self.languages:
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        cos = _unit(np.sqrt(rows) * self.idf.astype(np.float32)) @ self.centroids.T.astype(np.float32)
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1)
        low = score < self.floors[np.searchsorted(LENGTHS, letters)]
        return [(self.languages[self.owner[b]], float(s), bool(r)) if n else (UNDETERMINED, 0.0, True) for b, s, r, n in zip(best, score, low, letters, strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; starts are rows far from each other."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[of == j].sum(axis=0)) if (of == j).any() else c[j] for j in range(len(c))])
    return c


#: The buckets that a text fills, how often, its number of letters, and its language.
Counted = tuple[np.ndarray, np.ndarray, int, str]


def sparse(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that a whole text fills, how often, and its number of letters."""
    c, n = counts(text)
    filled = np.flatnonzero(c)
    return filled.astype(np.uint16), c[filled].astype(np.float32), n


def fit(rows: list[tuple[str, str]], centroids: int = CENTROIDS) -> Model:
    """The model of (text, language) rows."""
    return fit_counts([(*sparse(t), lang) for t, lang in rows], centroids)


def fit_counts(rows: list[Counted], centroids: int = CENTROIDS) -> Model:
    """The model of counted texts."""
    taken = [r for r in rows if r[2]]
    languages = sorted({r[3] for r in taken})
    if not taken:
        return Model(np.ones(BUCKETS), np.zeros((0, BUCKETS)), [], np.zeros(0, dtype=int), np.zeros(len(LENGTHS) + 1))
    held = np.zeros(BUCKETS)
    for filled, *_ in taken:
        held[filled] += 1
    idf = (np.log((1 + len(taken)) / (1 + held)) + 1).astype(np.float32)
    of = {lang: [r for r in taken if r[3] == lang] for lang in languages}

    def rows_of(lang: str) -> np.ndarray:
        x = np.zeros((len(of[lang]), BUCKETS), dtype=np.float32)
        for i, (filled, times, *_) in enumerate(of[lang]):
            x[i, filled] = np.sqrt(times) * idf[filled]
        return _unit(x)

    parts = [_clustered(rows_of(lang), centroids) for lang in languages]  # the dense rows of one language at a time
    c, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    best = np.concatenate([(rows_of(lang) @ c.T).max(axis=1) for lang in languages])
    size = np.searchsorted(LENGTHS, [r[2] for lang in languages for r in of[lang]])
    floors = np.zeros(len(LENGTHS) + 1)
    for i in range(len(floors)):  # a class with few texts takes the floor of the next shorter one, which is lower
        enough = (size == i).sum() >= 20
        floors[i] = SLACK * np.quantile(best[size == i], QUANTILE) if enough else floors[i - 1] if i else 0.0
    return Model(idf, c, languages, owner, floors)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: int, size: int) -> list[Counted]:
    """At most ``size`` rows of each language from the training part, ``FIT_ROWS`` in all: those of smallest hash of id and text.

    A slice of the hash range that holds about twice as many rows is counted and ranked; the driver gets the counts of
    ``size`` rows a language.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("struct<filled:binary,times:binary,letters:bigint>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        found = [(f.tobytes(), k.tobytes(), n) for f, k, n in map(sparse, texts)]
        return pd.DataFrame(found, columns=["filled", "times", "letters"])

    part = docs.filter((remainder(id_col, fold) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    part = part.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    each = part.groupBy("l").agg(F.count(F.lit(1)).alias("n")).persist()
    languages = each.count()
    size = max(1, min(size, FIT_ROWS // max(1, languages)))
    each = each.select("l", F.least(F.lit(1.0), 2.0 * size / F.col("n") + 0.001).alias("share"))
    each = F.broadcast(each) if languages <= FIT_ROWS else each  # a row a language
    thin = part.join(each, "l").filter((F.pmod("h", F.lit(1_000_003)) / 1_000_003) < F.col("share")).select("l", counted(F.col("t")).alias("c"), "h")
    ranked = thin.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("h", "c"))).filter(F.col("k") <= size)
    rows = ranked.select("l", "k", "c.*").orderBy("l", "k").collect()
    return [(np.frombuffer(r["filled"], dtype=np.uint16), np.frombuffer(r["times"], dtype=np.float32), r["letters"], r["l"]) for r in rows]


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, size: int = SAMPLE) -> Model:
    """The model learned from the rows of ``docs`` whose crc32 of the id, modulo ``fold``, is not 0."""
    return fit_counts(sample(docs, id_col, text_col, lang_col, fold, size))


def predictor(docs: DataFrame, model: Model):  # noqa: ANN201
    """A column function: struct of lang, score, rejected for a text column."""
    prepare(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = worker_state(key, lambda: sent.value)
        for texts in batches:
            found = [x for i in range(0, len(texts), 64) for x in model.predict(texts.iloc[i : i + 64].tolist())]
            yield pd.DataFrame(found, columns=["lang", "score", "rejected"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected."""
    model = model or fitted(docs, id_col, text_col, lang_col, fold)
    p = predictor(docs, model)(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, fold) == 0).alias("held_out"), p.alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def keep_accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    model = fitted(docs, id_col, text_col, lang_col, fold)
    return docs.filter(~predictor(docs, model)(F.col(text_col))["rejected"])
