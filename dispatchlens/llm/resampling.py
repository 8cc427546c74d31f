"""Target-distribution importance resampling by hashed n-grams.

Separators collapse to single spaces; ``regex`` then scans with ``overlapped=True`` and lookarounds at the
words' ends, so each match's span is one n-gram, whose bytes are counted by CRC. A bucket's gain
is the log ratio of its shares among the target's and the corpus's n-grams, a document's weight the mean gain of
its n-grams, and documents are drawn without replacement by weight plus Gumbel noise from a hash of the id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common

SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Drawn documents of one range of ranks, about.
RANGE_ROWS = 1_000_000


def patterns(longest: int) -> list[regex.Pattern]:
    """For each n up to ``longest`` a pattern whose overlapped matches are the runs of n words."""
    return [regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (n - 1) + rb"(?![^ ])") for n in range(1, longest + 1)]


def crcs(text: bytes, scans: list[regex.Pattern]) -> list[np.ndarray]:
    """The CRCs of a text's n-grams, one array for each n."""
    plain = SEPARATORS.sub(b" ", text.lower())  # bytes.lower() changes A-Z alone
    return [np.fromiter((zlib.crc32(match[0]) for match in scan.finditer(plain, overlapped=True)), np.uint32) for scan in scans]


def counted(texts: DataFrame, keys: list[str], longest: int, buckets: int) -> DataFrame:
    """``keys``, ``n_words``, ``n_features`` and the n-grams' counts by bucket (``bucket``, ``times``: arrays) of each row of ``texts(*keys, text)``."""
    schema = ", ".join([*(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys), "n_words long, n_features long, bucket array<int>, times array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = patterns(longest)
        for batch in batches:
            column = batch.column(len(keys))
            for a, b in common.slices(pc.binary_length(column).to_pylist()):
                words, grams, found, times = [], [], [], []
                for text in column.slice(a, b - a).cast(pa.binary()).to_pylist():
                    per_n = crcs(text, scans)
                    some, n = np.unique(np.concatenate(per_n) % buckets, return_counts=True)
                    words.append(len(per_n[0]))
                    grams.append(sum(map(len, per_n)))
                    found.append(some.astype(np.int32))
                    times.append(n.astype(np.int32))
                arrays = [*(batch.column(i).slice(a, b - a) for i in range(len(keys))), pa.array(words, pa.int64()), pa.array(grams, pa.int64())]
                arrays += [pa.array(x, pa.list_(pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "n_words", "n_features", "bucket", "times"])

    return texts.mapInArrow(run, schema)


def totals(counts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of all rows are in each bucket: summed within tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(own, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counts.select("bucket", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of each bucket's smoothed share among the target's n-grams by that among the corpus's."""
    s, t = corpus.tolist(), target.tolist()
    total_s, total_t = float(sum(s) + len(s)), float(sum(t) + len(t))
    return np.array([math.floor(1000 * math.log((y + 1.0) * total_s / ((x + 1.0) * total_t))) for x, y in zip(s, t)], np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counts`` with ``weight``, the floored mean gain of a row's n-grams (0 without any), for the two arrays."""
    sent = counts.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("long")
    def total(bucket, times):
        # of each row on its own: rows with many n-grams need not be joined into one array
        return bucket.combine(times, lambda b, n: int(sent.value[b] @ n.astype(np.int64)) if len(b) else 0).astype("int64")

    mean = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (total - pmod(total, n_features)) div n_features END")
    return counts.withColumn("total", total("bucket", "times")).withColumn("weight", mean).drop("bucket", "times", "total")


def gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], most: int, ranges: int) -> DataFrame:
    """Rows with their place in ``order`` (``rank``, from 1; null beyond ``most``), by ranges that are numbered apart."""
    part = common.written(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    place = F.col("place") + F.col("base")
    return part.withColumn("place", own).join(base, "part").withColumn("rank", F.when(place <= most, place)).drop("part", "place", "base")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long) of every row of ``docs(doc_id, text)``.

    Of the N documents with at least ``least_words`` words, the ``floor(percent N / 100)`` with the highest scores
    are drawn, ties to the smaller id; ``rank`` is their place, null for the others. N-grams are runs of 1 to
    ``longest`` words; ``target(text)`` is what the draw shall resemble.

    Null text has no words. A null id hashes as the text ``null`` and comes last among ties. Repeated ids and rows
    are documents of their own (the order among equal ones is any). An empty corpus gives no rows; an empty
    target counts as no n-grams at all. Other columns are not read.

    Texts are scanned once: counts by bucket are written to the shared folder and read again for the totals
    and the weights. The driver holds ``buckets`` totals and scores' counts only: a score is a sum of two
    numbers within 1000 times the logarithm of 64-bit counts, so there are at most some 200,000 scores.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    counts = common.written(counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), ["doc_id"], longest, buckets), "features")
    wanted = totals(counted(target.select(text), [], longest, buckets), buckets)
    own = weighed(counts, gains(totals(counts, buckets), wanted))
    own = own.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")).withColumn("row", F.monotonically_increasing_id())
    own = common.written(own, "scores")
    can = F.col("n_words") >= least_words
    by_score = own.filter(can).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    most = percent * sum(r["n"] for r in by_score) // 100
    near, limit = 0, 1 << 62  # documents from the lowest drawn score on, and that score
    for r in by_score:
        if near >= most:
            break
        near, limit = near + r["n"], r["score"]
    above = can & (F.col("score") >= F.lit(limit))  # the drawn ones, and ties with the last of them
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    first = ranked(own.filter(above), order, most, max(1, -(-near // RANGE_ROWS)))
    rest = own.filter(~F.coalesce(above, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
