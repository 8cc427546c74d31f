"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words are runs of word characters or of other signs, in lower case. A word that was among the
two before it becomes a mark for a repeat, and a word in capitals is marked too, so the
n-grams of repetitive or shouted text recur although its words don't. Unigrams and
bigrams are hashed into a fixed number of weights; a text's score is the sparse dot
product of its normalised log counts with the weights.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common
from dispatchlens.llm.pretokens import Numbered

BITS = 18
WORD = re.compile(r"\w+|[^\w\s]+")
#: Labelled rows that the classifier is fitted on, at most about, and those of one task.
FIT_ROWS, SHARD_ROWS = 12_000, 1500
EPOCHS = 3
# Learning rate, its offset, and the L1 and L2 penalties of the leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Length of a text's vector of n-grams, against the bias of 1.
LENGTH = 4.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


REPEAT, CAPITALS = np.uint64(hashed("\x00repeat")), np.uint64(hashed("\x00capitals"))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the indices of its n-grams and their values (of length ``LENGTH`` together); index 0 is the bias, of value 1."""
    seen, rows, sizes = Numbered(), [], []
    for text in texts:
        own = list(map(seen.__getitem__, WORD.findall(text)))
        rows += own
        sizes.append(len(own))
    word = np.array(rows, np.int64)
    words = list(seen)
    loud = np.fromiter((len(w) > 1 and w.isupper() for w in words), bool, len(words))
    lower = Numbered()
    low = np.fromiter((lower[w.lower()] for w in words), np.int64, len(words))
    code = np.fromiter(map(hashed, lower), np.uint64, len(lower))
    doc = np.repeat(np.arange(len(texts)), sizes)
    same = low[word] if len(words) else word
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (same[back:] == same[:-back]) & (doc[back:] == doc[:-back])
    h = np.where(again, REPEAT, code[same]) if len(word) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        pair = ((h[:-1] * MIX) ^ h[1:]) * MIX >> shift
        one = h * MIX >> shift
        caps = CAPITALS * MIX >> shift
    joined = doc[:-1] == doc[1:]
    shouted = loud[word] if len(words) else again
    place = np.concatenate([doc, doc[:-1][joined], doc[shouted]])
    index = np.concatenate([one, pair[joined], np.full(int(shouted.sum()), caps)]).astype(np.int64)
    key, count = np.unique(place << BITS | np.maximum(index, 1), return_counts=True)
    value = np.log1p(count)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        v = value[a:b]
        out.append((np.append(key[a:b] & ((1 << BITS) - 1), 0), np.append(v * LENGTH / np.sqrt((v**2).sum()) if b > a else v, 1.0)))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights after passes of per-coordinate follow-the-regularised-leader (proximal) updates in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (index, value), label in zip(rows, labels):
            w = weights(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights learnt from a sample of about ``fit_rows`` labelled documents, chosen by a hash of the id.

    ``labels(doc_id, quality)``: null ids or labels are left out; of repeated labels the largest counts.
    Tasks learn on disjoint shards, each in a fixed order, and the mean of their weights
    is used. Without any labelled document all weights are zero (every score is 0.5).
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    share, shards = fit_rows / max(1, n), max(1, min(n, fit_rows) // SHARD_ROWS)
    sample = F.broadcast(known.filter(common.hash_fraction("doc_id") < share))  # about fit_rows rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=[hashed(f"{i} {t}") for i, t in zip(frame["doc_id"], frame["text"])]).sort_values("order", kind="stable")
        own: list = []
        for a, b in common.slices(frame["text"].str.len().tolist()):
            own += features(frame["text"].iloc[a:b].tolist())
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "w": [ftrl(own, frame["quality"].tolist()).astype("<f4").tobytes()]})

    learnt = sorted(rows.groupBy("shard").applyInPandas(learn, "shard long, w binary").collect())
    return np.mean([np.frombuffer(r["w"], "<f4") for r in learnt], axis=0) if learnt else np.zeros(1 << BITS, np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    raw = np.array([weights[index] @ value for index, value in features(texts)])
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def scorer(spark, weights: np.ndarray):
    """A column function from text (null: empty) to the score, with ``weights`` sent once to each worker."""
    sent = spark.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        texts = column.fillna("")
        out = [scores(texts.iloc[a:b].tolist(), sent.value) for a, b in common.slices(texts.str.len().tolist())]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Only labels of documents that aren't held out (see :func:`held_out`) are learnt from, and the text is
    a score's only input. Null and empty texts get the score of the bias alone. Repeated rows
    get repeated results; an empty table gives none; other columns are not read.
    """
    weights = fit(docs, labels.filter(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), scorer(docs.sparkSession, weights)(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out():
    return common.crc_mod("doc_id", 3) == 1


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is at least ``least``."""
    weights = fit(docs, labels.filter(~held_out()))
    return docs.filter(scorer(docs.sparkSession, weights)(F.col("text").cast("string")) >= least)
