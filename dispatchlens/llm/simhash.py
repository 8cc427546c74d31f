"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two bit errors at
least one segment has none, and no segment has more than two. Each segment, taken as a word
of the perfect Golay code [23, 12, 7], has as its fuzzy keys the codewords within distance 4:
one codeword, or six if the nearest is at distance 3. Two words that differ in at most two
bits always share a codeword, because the codeword of a word halfway is within 4 of both. So
the join keys of a fingerprint are, for each segment, that segment exactly and the fuzzy keys
of the next one: every pair within two bits meets, and every meeting is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common

# Generator polynomial of the binary Golay code, and its sizes.
GENERATOR, LENGTH, CHECK_BITS = 0xAE3, 23, 11
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
MAX_BITS = 2
#: Fingerprints with a join key, beyond which its pairs aren't written out (see ``links``).
PAIRED = 64
#: Shingles hashed at a time, for bounded memory in very long texts.
BLOCK = 1 << 18


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK_BITS)), rest)
    return rest


@cache
def patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight up to 4 that lead to codewords (-1: none), the lightest first."""
    out = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, int)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for s, e in zip(syndromes(errors).tolist(), errors.tolist()):
            out[s, used[s]] = e
            used[s] += 1
    return out


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for up to 18 keys of each fingerprint."""
    at, keys = [], []
    cut = [(prints >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]
    for i, exact in enumerate(cut):
        word = cut[(i + 1) % len(cut)]
        errors = patterns()[syndromes(word)]
        row, col = np.nonzero(errors >= 0)
        fuzzy = (word[row] ^ errors[row, col]) >> CHECK_BITS
        at.append(row)
        keys.append((np.int64(i) << 34) | (exact[row] << 12) | fuzzy)
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in more than half of the shingles' XXH64; words are split at ASCII white space, A-Z in lower case."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        part = words[first : last + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", last - first)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text, to find the row again) and ``fp`` (the fingerprint as a signed long)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the distinct fingerprints ``fp`` whose components are those of all pairs within two bits.

    Keys of up to ``PAIRED`` fingerprints are joined pairwise and verified. The members of fuller
    keys instead meet at centres: a pair within two bits has a word within one bit of both, so
    each member names itself and its 64 neighbours, and all (at most 65) that name a word are
    pairwise within two bits and linked to the smallest. Neither way leaves a pair out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, keys = join_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])

    keyed = common.written(prints.select("fp").mapInArrow(run, "key long, fp long"), "keys")
    # written, so that the joins have plain exchanges on both sides and a hot key's rows can be split
    shared = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    few = keyed.join(shared.filter(F.col("n") <= PAIRED).select("key"), "key")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    crowded = keyed.join(shared.filter(F.col("n") > PAIRED).select("key"), "key", "left_semi").select("fp").distinct()
    centres = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)]
    named = crowded.select("fp", F.explode(F.array(*centres)).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    stars = named.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Group ``docs(doc_id, text)`` by fingerprints that are linked at two or fewer differing bits.

    Returns per document ``doc_id``, ``text_key``, ``fp``, ``root`` (one fingerprint for each
    group) and ``component_id`` (the smallest doc_id reachable, itself included). Texts of fewer
    words than a shingle are one shingle; null and empty texts have fingerprint zero and are
    linked like any other. Null ids never are the smallest, unless a group has no other:
    then component_id is null. Repeated rows get repeated results; an empty table gives none;
    other columns are not read.

    Copies share a fingerprint, so all joins work on distinct fingerprints; a fingerprint that a
    third of all documents have is one row there.
    """
    own = common.written(fingerprints(docs, shingle), "fingerprints")
    nodes = common.written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = common.components(links(nodes), nodes, "fp", "a", "b")
    firsts = nodes.join(roots, "fp")
    group = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(firsts.select("fp", "root").join(group, "root"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns kept, without near duplicates: of each group the row with
    the smallest doc_id stays (null last; of equal ids the smallest text hash, of equal rows one)."""
    found = near_duplicates(docs, shingle)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key")).distinct()
    kept = kept.select(F.coalesce("__id", F.lit(-1)).alias("__id"), F.col("__id").isNull().alias("__null"), "__key")
    a, b, c, n = (common.free_name(docs, x) for x in ("id", "null", "key", "n"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns({a: F.coalesce(doc_id, F.lit(-1)), b: doc_id.isNull(), c: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    kept = kept.toDF(a, b, c)
    one = Window.partitionBy(a, b, c).orderBy(F.lit(1))
    return rows.join(kept, [a, b, c], "left_semi").withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).drop(a, b, c, n)


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
