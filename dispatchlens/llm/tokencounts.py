"""Token counts by a two-tier lookup on the map side.

Tier one: a compact hash table of the frequent pre-tokens' numbers of tokens, sent to every
worker once. Tier two: other pre-tokens are encoded by the tokenizer's library and remembered in the worker.
Pre-tokens are never shuffled: texts go in and one number a text comes out of the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common, pretokens
from dispatchlens.llm.packing import Ids

#: Documents that the frequent pre-tokens are counted on, about, and how many of them the table holds.
SAMPLE_ROWS, FREQUENT = 4000, 1 << 16


class Lengths:
    """Numbers of tokens of whole texts, as the library of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file gives them.

    ``frequent`` only saves work: whatever it holds, the numbers are the library's.
    """

    def __init__(self, file: bytes, pieces: bool):
        self.file, self.frequent = file, pretokens.Table(0, np.uint8)
        self.ids = None if pieces else Ids(file.decode("utf-8"))
        self.memory = self.processor = None

    def __getstate__(self):
        return self.__dict__ | {"memory": None, "processor": None}

    def _pieces(self, texts: list[str]) -> np.ndarray:
        if self.processor is None:
            from sentencepiece import SentencePieceProcessor

            self.processor = SentencePieceProcessor(model_proto=self.file)
        return np.fromiter((len(self.processor.encode(t)) for t in texts), np.int64, len(texts))

    def of(self, texts: list[str]) -> np.ndarray:
        if self.ids is None:
            return self._pieces(texts)
        self.memory = self.memory or pretokens.Memory()
        whole = list(map(self.ids.whole, texts))
        own = pretokens.Pretokens(["" if w else t for t, w in zip(texts, whole)])
        n = self.frequent.find(own.lo, own.hi)
        rest, long = np.flatnonzero((n < 0) & (own.hi != 0)), np.flatnonzero(own.hi == 0)
        n[rest], _ = self.memory.of(own.lo[rest], own.hi[rest], lambda some: [[x] for x in self.library([own.piece(i) for i in rest[some].tolist()])])
        if len(long):
            seen = pretokens.Numbered()
            number = [seen[own.piece(i)] for i in long.tolist()]
            n[long] = np.array(self.library(list(seen)))[number]
        out = np.diff(np.concatenate(([0], np.cumsum(n)))[own.first])
        for i in np.flatnonzero(whole).tolist():
            out[i] = len(self.ids.library([texts[i]])[0])
        return out

    def library(self, pieces: list[bytes]) -> list[int]:
        return [len(x) for x in self.ids.library([p.decode() for p in pieces])]

    def learn_frequent(self, batches: Iterator[pa.RecordBatch], most: int) -> pretokens.Table:
        """The table of the ``most`` short pre-tokens that occur most often in the texts of some batches."""
        seen, lo, hi = pretokens.Table(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        count = np.zeros(0, np.int64)
        for texts in sliced(batches):
            own = pretokens.Pretokens(texts)
            short = np.flatnonzero(own.hi)
            at, number = pretokens.distinct(own.lo[short], own.hi[short])
            times = np.bincount(number, minlength=len(at))
            # one list of all keys so far, each once
            lo, hi, count = np.append(lo, own.lo[short[at]]), np.append(hi, own.hi[short[at]]), np.append(count, times)
            at, number = pretokens.distinct(lo, hi)
            lo, hi, count = lo[at], hi[at], np.bincount(number, count).astype(np.int64)
        top = np.lexsort((lo, hi, -count))[:most]
        lo, hi = lo[top], hi[top]
        size = (hi >> np.uint64(56)).astype(int).tolist()
        pieces = [(a.to_bytes(8, "little") + (b & (1 << 56) - 1).to_bytes(8, "little"))[:n] for a, b, n in zip(lo.tolist(), hi.tolist(), size)]
        seen = pretokens.Table(len(top), np.uint8)
        seen.add(lo, hi, np.array(self.library(pieces), np.uint8))
        return seen


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The texts (last column) of batches in slices."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for a, b in common.slices(pc.binary_length(column).to_pylist()):
            yield column.slice(a, b - a).to_pylist()


def frequent_table(texts: DataFrame, lengths: Lengths, sample_rows: int, most: int) -> pretokens.Table:
    """Counted in one task on a random sample of about ``sample_rows`` rows of ``texts``."""
    share = min(1.0, sample_rows / max(1, texts.count()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lengths.learn_frequent(batches, most)
        own = table.hi != 0
        yield pa.RecordBatch.from_arrays([pa.array([x[own].tobytes()]) for x in (table.lo, table.hi, table.value)], ["lo", "hi", "n"])

    out = pretokens.Table(most, np.uint8)
    for r in texts.sample(share, 1).repartition(1).mapInArrow(learn, "lo binary, hi binary, n binary").collect():  # one row, of 17 bytes an entry
        out.add(np.frombuffer(r.lo, np.uint64), np.frombuffer(r.hi, np.uint64), np.frombuffer(r.n, np.uint8))
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, sample_rows: int = SAMPLE_ROWS, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    ``n_tokens`` is what the file's library gives for the whole text, without special tokens added; an added
    token's string inside a text is that token. ``over_limit``: more than ``limit`` tokens.

    Null text counts as empty: no bytes, no tokens. Rows are independent: null and repeated ids and repeated
    rows give a row each; an empty table none; other columns are not read. The table sent to the workers
    has at most ``frequent`` entries of 17 bytes in twice to four times as many places, whatever the input's size; a worker
    remembers at most two generations of :data:`pretokens.REMEMBERED` others. A text with an added token's
    string, and every text if the tokenizer isn't a byte-level one, goes to the library whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with open(tokenizer_path, "rb") as file:
        lengths = Lengths(file.read(), tokenizer_path.endswith(".model"))
    if lengths.ids is not None and lengths.ids.apart:
        lengths.frequent = frequent_table(rows.select("text"), lengths, sample_rows, frequent)
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *map(sent.value.of, sliced([batch]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
