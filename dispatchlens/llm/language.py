"""Language identification by the nearest of several clustered centroids per language.

Texts become TF-IDF vectors of hashed character n-grams (bytes of the lower-cased text, 1 to 3
long, within a fixed number of dimensions), normalised to length one. Each language's training
vectors are clustered (spherical k-means); a text takes the language of the centroid with
the largest cosine. A text that is farther from its centroid than that centroid's own limit,
or that has no letter, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common

DIMS = 1 << 13
#: Documents that a language's centroids are fitted on, at most about, and its centroids.
FIT_ROWS, CENTROIDS = 1000, 4
ROUNDS = 8
#: A text is rejected below this share of its centroid's lowest training cosine (the 1st percentile). That percentile
#: is taken from ``MEMBERS`` documents at least; ``USUAL`` stands for it where no language has so many.
SLACK, MEMBERS, USUAL = 0.4, 20, 0.5
UNKNOWN = "und"
#: Texts that become one dense matrix.
ROWS = 64
# Odd multipliers of the n-gram hash, one for each byte and one for each n-gram length.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32) + 1
    out = np.zeros(DIMS, np.int64)
    h = np.zeros(len(b), np.uint32)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    with np.errstate(over="ignore"):
        for i, f in enumerate(FACTORS[: len(b)]):
            h = (h[: len(b) - i] + b[i:]) * np.uint32(f)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(FACTORS[0])) >> shift, minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of length one (of zeros, where a text has nothing)."""
    x = np.stack([counts(t) for t in texts]).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def clustered(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, begun at points far apart, and the lowest cosine that each accepts.

    A centroid of few members lies close to each of them, which tells nothing about other texts: it takes the limit of the
    language's larger centroids together, or NaN if there is none.
    """
    x = x[(x * x).sum(1) > 0]
    at = [0]
    while len(at) < min(n, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(1))))
    centres = x[at]
    for _ in range(ROUNDS if len(x) else 0):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = x @ centres.T
    own = np.argmax(cosines, axis=1) if len(x) else np.zeros(0, int)
    large = np.bincount(own, minlength=len(centres)) >= MEMBERS
    lowest = lambda some: np.quantile(cosines[some, own[some]], 0.01) * SLACK if some.any() else np.nan
    limits = [lowest(own == c if large[c] else large[own]) for c in range(len(centres))]
    return centres.astype(np.float32), np.array(limits)


class Centroids:
    """The fitted classifier."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, limits: np.ndarray):
        self.idf, self.langs, self.centres, self.limits = idf, langs, centres, limits

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """``lang_pred`` (the nearest centroid's language, or ``und``), ``score`` (the cosine) and ``accepted``."""
        lang, score, accepted = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        told = np.array([i for i, t in enumerate(texts) if has_letter(t)], int) if self.langs else np.zeros(0, int)
        for a in range(0, len(told), ROWS):
            some = told[a : a + ROWS]
            cosine = vectors([texts[i] for i in some], self.idf) @ self.centres.T
            best = np.argmax(cosine, axis=1)
            score[some] = np.clip(cosine[np.arange(len(some)), best], 0, 1)
            lang[some] = [self.langs[b] for b in best]
            accepted[some] = score[some] >= self.limits[best]
        return pd.DataFrame({"lang_pred": lang, "score": score, "accepted": accepted})


def held_out():
    return common.crc_mod("doc_id", 4) == 2


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Centroids:
    """Document frequencies of all rows, centroids of about ``fit_rows`` documents of each language, chosen by a hash of id
    and text; rows without language, without a letter or held out are left out. Without any row nothing can be told (all ``und``)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null").filter(~held_out())
    shares = known.groupBy("lang").agg((F.lit(float(fit_rows)) / F.count("*")).alias("share"))
    sample = common.written(known.join(F.broadcast(shares), "lang").filter(common.hash_fraction("doc_id", "text") < F.col("share")).select("lang", "text"), "languages")

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMS + 1, np.int64)  # the last one counts the documents
        for frame in frames:
            for t in filter(has_letter, frame["text"]):
                df[:DIMS] += counts(t) > 0
                df[DIMS] += 1
        at = np.nonzero(df)[0]
        yield pd.DataFrame({"at": at, "df": df[at]})

    df = np.zeros(DIMS + 1, np.int64)
    for r in known.select("text").mapInPandas(frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():  # at most DIMS + 1 rows
        df[r["at"]] = r["df"]
    idf = (1 + np.log((1 + df[DIMS]) / (1 + df[:DIMS]))).astype(np.float32)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in frame["text"] if has_letter(t))
        if not texts:
            return pd.DataFrame({"lang": [], "centre": [], "low": []})
        centres, limits = clustered(np.concatenate([vectors(texts[a : a + ROWS], idf) for a in range(0, len(texts), ROWS)]), centroids)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "low": limits})

    found = sorted(sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, low double").collect())
    centres = np.array([np.frombuffer(r["centre"], np.float32) for r in found]).reshape(-1, DIMS)
    limits = np.array([r["low"] for r in found], float)
    told = ~np.isnan(limits)
    limits[~told] = np.median(limits[told]) if told.any() else USUAL * SLACK
    return Centroids(idf, [r["lang"] for r in found], centres, limits)


def predictor(spark, model: Centroids):
    sent = spark.sparkContext.broadcast((model.idf, model.langs, model.centres, model.limits))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(column: pd.Series) -> pd.DataFrame:
        own, texts = Centroids(*sent.value), column.fillna("")
        return pd.concat([own.predict(texts.iloc[a:b].tolist()) for a, b in common.slices(texts.str.len().tolist())] or [own.predict([])], ignore_index=True)

    return predict


def predicted_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and ``accepted`` of every row of ``docs(doc_id, text, lang)``.

    Only text and language of documents that aren't held out (see :func:`held_out`) are learnt from; a prediction
    reads the text alone. ``und`` with score 0 if the text is null, has no letter, or nothing was
    learnt; otherwise ``lang_pred`` is a learnt language, and ``accepted`` tells whether its centroid is
    near enough. Ties go to the language that sorts first. Repeated rows get repeated results;
    an empty table gives none; other columns are not read.
    """
    predict = predictor(docs.sparkSession, fit(docs))
    told = predict(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), told.alias("told"))
    return rows.select("doc_id", "held_out", "told.lang_pred", "told.score", "told.accepted")


def keep_told(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is near enough to a learnt language."""
    told = predictor(docs.sparkSession, fit(docs))(F.col("text").cast("string"))
    return docs.filter(told["accepted"])
