"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The packing is planned on the histogram of piece lengths (at most one row per length up
to the capacity), not on documents: best-fit decreasing moves whole counts at a time.
Pieces then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common, pretokens

#: Pieces of one rank window, about.
RANK_ROWS = 20_000
#: Pre-tokens that the library encodes at once: each result takes about 1 KB.
ASKED = 256
PLAN = "length int, rank_from long, n long, per_sequence long, sequence_from long, offset_from long"


class Ids:
    """Token ids of whole texts by the tokenizers library, asked once for each distinct pre-token.

    A byte-level tokenizer treats each pre-token apart, so the ids are the library's ids
    of the whole text. Texts that hold an added token's string go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        self.json = tokenizer_json
        config = json.loads(tokenizer_json)
        self.added = [t["content"] for t in config.get("added_tokens") or []]
        pre = config.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer")
        self.tokenizer = self.memory = None

    def __getstate__(self):
        return self.__dict__ | {"tokenizer": None, "memory": None}

    def library(self, pieces: list[str]) -> list[list[int]]:
        """Ids by the library."""
        if self.tokenizer is None:
            # the library's threads would wait busily for each other on a machine that Spark fills
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.json)
        return [e.ids for a in range(0, len(pieces), ASKED) for e in self.tokenizer.encode_batch_fast(pieces[a : a + ASKED], add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether a text's pre-tokens can't be told apart from the rest of it."""
        return not self.apart or any(a in text for a in self.added)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        self.memory = self.memory or pretokens.Memory()
        whole = list(map(self.whole, texts))
        own = pretokens.Pretokens(["" if w else t for t, w in zip(texts, whole)])  # those that go whole are left out here
        short, long = np.flatnonzero(own.hi), np.flatnonzero(own.hi == 0)
        ask = lambda some: self.library([own.piece(i).decode() for i in some.tolist()])
        ids, begin = self.memory.of(own.lo[short], own.hi[short], lambda some: ask(short[some]))
        groups = [(short, ids, np.diff(begin))]
        if len(long):
            got = ask(long)
            groups.append((long, np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64)))
        flat, begin = pretokens.placed(len(own), groups)
        cut = begin[own.first].tolist()
        return [np.array(self.library([t])[0], np.uint32) if w else flat[a:b] for t, w, a, b in zip(texts, whole, cut[:-1], cut[1:])]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Ids(open(tokenizer_path, encoding="utf-8").read()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in common.slices(pc.binary_length(column).to_pylist()):
                out = []
                for doc_id, ids in zip(doc_ids[a:b], sent.value.of(column.slice(a, b - a).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, stop = 0, (len(ids) - 1) % capacity + 1
                    for piece in range(-(-len(ids) // capacity)):
                        own = ids[start:stop]
                        out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), *[own.astype(np.int64)] * with_ids))
                        start, stop = stop, stop + capacity
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, rank_from, n, per_sequence, sequence_from, offset_from)``.

    The pieces of a length with ranks ``rank_from .. rank_from + n - 1`` go, ``per_sequence``
    to each, into the sequences from ``sequence_from`` on, the first of each at ``offset_from``.
    Sequences with equal room are one run; each length adds at most four runs, and a
    sequence holds at most sqrt(2 * capacity) lengths, so the plan has at most
    4 * capacity * sqrt(2 * capacity) rows, however many documents there are.
    """
    rooms: list[int] = []  # sorted; of runs of sequences that have this room left
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, per, first, capacity - room))
                put(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left:
                plan.append((length, rank, left, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return plan


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    A document is its token ids and then ``end_id``; only longer ones than the capacity are
    cut, the first piece taking the remainder. Returns per piece ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` (and ``ids``); sequences are filled without gaps from 0.

    Null text counts as empty (one piece with ``end_id`` alone). Null and repeated ids and
    repeated rows are separate documents. An empty table gives no rows. Other input
    columns are not read.

    The pieces are tokenized once and written to the shared folder without texts. Ranks
    within a length come from salted windows, so a length that a third of all pieces have
    is many tasks. Only the histogram (``capacity`` rows) reaches the driver, and the plan
    that is broadcast is bounded by the capacity alone (see :func:`best_fit_plan`).
    """
    spark = docs.sparkSession
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, end_id, with_ids)
    pieces = common.written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), PLAN)
    salts = max(64, sum(histogram.values()) // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rn", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rn") + F.col("base"))
    slot = F.col("rank") - F.col("rank_from")
    fits = F.col("rank").between(F.col("rank_from"), F.col("rank_from") + F.col("n") - 1)
    placed = ranked.alias("p").join(F.broadcast(plan).alias("q"), (F.col("p.length") == F.col("q.length")) & fits)
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("sequence_from") + F.floor(slot / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + slot % F.col("per_sequence") * F.col("p.length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
