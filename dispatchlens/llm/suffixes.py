"""Removal of repeated byte strings by sorted suffixes and their common prefixes.

A byte goes if a window of ``span`` bytes that covers it starts anywhere else as well. Sorting
every suffix of the corpus would move it hundreds of times over, so suffixes are sampled by content:
in each window the 64-byte gram with the smallest hash is its anchor. Equal windows have equal
grams at equal offsets, so only suffixes that start at anchors with a repeated gram are sorted,
each with the text to its left that its windows need (about one for 170 bytes of repeated text).

Map tasks sort their suffixes and send them as front-coded runs (length of the prefix shared with the
suffix before, and the rest), dealt out by gram. Reduce tasks merge the runs with a loser tree that
carries common-prefix lengths and never looks at a known prefix again; the merged order comes
with the common prefix of neighbours. A window at offset ``o`` before its anchor repeats if another
suffix shares ``span - o`` bytes to the right (the order's common prefixes) and ``o`` bytes to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common

GRAM = 64
#: Windows of a long text looked at in one go.
BLOCK = 1 << 18
#: Bytes of text whose runs, or whose results, one step makes.
RUN_BYTES, OUT_BYTES = 1 << 24, 1 << 21
#: Distinct suffixes of one merge, about, and of one gram, beyond which its windows are counted one by one.
MERGED, CROWDED = 20_000, 10_000
#: Suffixes of a gram up to which pairs are compared directly.
PAIRS = 24
# Odd multipliers of the gram hash.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
POSITION = np.uint64((1 << 20) - 1)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every position on."""
    x = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        for step, factor in zip((8, 16, 32), FACTORS):
            x = (x[:-step] ^ x[:-step] >> np.uint64(29)) * factor + x[step:]
        x = (x ^ x >> np.uint64(32)) * FACTORS[3]
    return x ^ x >> np.uint64(29)


def anchors(data: bytes, span: int) -> list[tuple[int, int, int, int]]:
    """``(gram hash, position, first window, last window)`` of the anchors; every window has one."""
    out: list = []
    grams = span - GRAM + 1
    for first in range(0, len(data) - span + 1, BLOCK):
        windows = min(BLOCK, len(data) - span + 1 - first)
        h = gram_hashes(data[first : first + windows + span - 1])
        # the smallest hash, the leftmost of equals: positions in the low bits
        value = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        wide = -(-len(value) // grams) * grams
        rows = np.full(wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        rows[: len(value)] = value
        rows = rows.reshape(-1, grams)
        to_left = np.minimum.accumulate(rows, axis=1).ravel()
        to_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(to_right[:windows], to_left[grams - 1 : grams - 1 + windows]) & POSITION).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        stop = np.append(start[1:], windows) - 1
        out += zip(h[at[start]].view(np.int64).tolist(), (at[start] + first).tolist(), (start + first).tolist(), (stop + first).tolist())
    return out


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    n = min(len(a), len(b))
    while known < n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return min(known, n)


def common_suffix(a: bytes, b: bytes) -> int:
    return shared(a[::-1], b[::-1], 0)


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common-prefix length with the string before, and the rest, of sorted strings."""
    lengths = [0, *(shared(a, b, 0) for a, b in zip(strings, strings[1:]))]
    return lengths[: len(strings)], [s[n:] for s, n in zip(strings, lengths)]


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge front-coded runs with a loser tree: ``(run, place in it, string, common prefix with the string before)``.

    Every waiting string knows the length of its common prefix with the last winner. Of two, the one with
    the longer is smaller, and the other's length holds against it as well; only equal lengths
    need a comparison, which starts behind them.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    place = [0] * len(runs)
    now: list[bytes | None] = [rest[0] if rest else None for _, rest in runs] + [None] * (k - len(runs))
    known = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x, y, known[a])
        first = len(x) <= len(y) if n == min(len(x), len(y)) else x[n] < y[n]
        winner, loser = (a, b) if first else (b, a)
        known[loser] = n
        return winner, loser

    losers = [0] * k
    best = list(range(k))
    while len(best) > 1:
        half = len(best) // 2
        games = [play(best[2 * i], best[2 * i + 1]) for i in range(half)]
        losers[half : 2 * half] = [loser for _, loser in games]
        best = [winner for winner, _ in games]
    top = best[0]
    while now[top] is not None:
        yield top, place[top], now[top], known[top]
        lengths, rest = runs[top]
        place[top] += 1
        if place[top] < len(rest):
            n = lengths[place[top]]
            now[top], known[top] = now[top][:n] + rest[place[top]], n
        else:
            now[top] = None
        node = (k + top) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1


def clusters(order: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """A number for each member, equal if they share ``length`` bytes: neighbours in ``order`` share ``prefix``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefix < length)
    return out


def repeats(lefts: list[bytes], rights: list[int], prefix: list[int], many: list[bool], span: int) -> list[list[tuple[int, int]]]:
    """For each suffix of one gram, in sorted order, the ranges of window offsets that repeat.

    ``lefts``: the text before each; ``rights``: lengths of the suffixes; ``prefix``: what each shares with the one before;
    ``many``: whether the same suffix with the same left text occurs several times.
    """
    low, high = [span - n for n in rights], [len(x) for x in lefts]
    out: list[list[tuple[int, int]]] = [[(a, b)] if m else [] for a, b, m in zip(low, high, many)]
    n = len(lefts)
    if n <= PAIRS:
        for i in range(n):
            right = span
            for j in range(i + 1, n):
                right = min(right, prefix[j])
                a, b = max(span - right, low[i], low[j]), min(high[i], high[j])
                if a <= b and not (many[i] and many[j]):
                    b = min(b, common_suffix(lefts[i], lefts[j]))
                    if a <= b:
                        out[i].append((a, b))
                        out[j].append((a, b))
        return out
    right_prefix = np.array(prefix)
    right_prefix[0] = -1
    back = [x[::-1] for x in lefts]
    left_order = np.array(sorted(range(n), key=back.__getitem__))
    left_prefix = np.array([-1, *(shared(back[i], back[j], 0) for i, j in zip(left_order[:-1].tolist(), left_order[1:].tolist()))])
    a, b = np.array(low), np.array(high)
    rest = ~np.array(many)
    open_from = np.full(n, -1)
    for o in range(min(low), max(high) + 2):
        valid = np.flatnonzero((a <= o) & (o <= b))
        hit = np.zeros(n, bool)
        if len(valid) > 1:
            key = clusters(np.arange(n), right_prefix, span - o)[valid] * (n + 1) + clusters(left_order, left_prefix, o)[valid]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            hit[valid] = count[inverse] > 1
        hit &= rest
        for i in np.flatnonzero(hit & (open_from < 0)).tolist():
            open_from[i] = o
        for i in np.flatnonzero(~hit & (open_from >= 0)).tolist():
            out[i].append((int(open_from[i]), o - 1))
            open_from[i] = -1
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``kd, th`` (which find a document, or rows that are the same, again) and the text's bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("kd"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"), *more)


def sampled(rows: DataFrame, span: int) -> DataFrame:
    """All anchors: ``kd, th, gram, sig, at, low, high``; ``sig`` stands for the anchor's whole surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kd, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in common.slices(pc.binary_length(batch.column(2)).to_pylist(), 4 * common.SLICE_CHARS):
                out = []
                for i in range(first, last):
                    data = batch.column(2)[i].as_py()
                    for gram, at, low, high in anchors(data, span) if len(data) >= span else ():
                        out.append((kd[i], th[i], gram, signature(data, at, low, high, span), at, low, high))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["kd", "th", "gram", "sig", "at", "low", "high"])

    return rows.mapInArrow(run, "kd long, th long, gram long, sig binary, at long, low long, high long")


def signature(data: bytes, at: int, low: int, high: int, span: int) -> bytes:
    return xxhash.xxh3_128_digest(b"%d %d " % (at - low, high - low) + data[low : high + span])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RUN = "part int, prefix binary, sizes binary, rest binary, left_sizes binary, lefts binary, sigs binary, many binary"


def sorted_runs(rows: DataFrame, span: int, parts: int) -> DataFrame:
    """Front-coded runs of the chosen suffixes of ``rows(data, chosen)``, one row for each part and slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in common.slices(pc.binary_length(b.column(0)).to_pylist(), RUN_BYTES)):
            dealt: dict[int, list] = {}
            for data, chosen in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                for c in chosen.as_py():
                    at = c["at"]
                    dealt.setdefault(c["gram"] % parts, []).append((data[at : c["high"] + span], data[c["low"] : at], c["sig"], c["many"]))
            out = []
            for part, own in dealt.items():
                own.sort()
                prefix, rest = front_coded([x[0] for x in own])
                short = lambda n: np.array(n, "<u2").tobytes()
                out.append((part, short(prefix), short([len(r) for r in rest]), b"".join(rest), short([len(x[1]) for x in own]), b"".join(x[1] for x in own), b"".join(x[2] for x in own), bytes(x[3] for x in own)))
            names = [c.split()[0] for c in RUN.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "part" else pa.binary()) for n, x in zip(names, zip(*out))], names)

    return rows.mapInArrow(run, RUN)


def pieces(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def merged_repeats(frame: pd.DataFrame, span: int) -> pd.DataFrame:
    """Merge a part's runs and tell the repeated ranges of offsets (``first``, ``last``) of each ``sig``."""
    short = lambda b: np.frombuffer(b, "<u2")
    runs = [(short(r.prefix).tolist(), pieces(r.rest, short(r.sizes))) for r in frame.itertuples()]
    lefts = [pieces(r.lefts, short(r.left_sizes)) for r in frame.itertuples()]
    sigs, many = frame["sigs"].tolist(), frame["many"].tolist()
    out: list[tuple[bytes, int, int]] = []
    group: list[tuple[int, int, int, int]] = []

    def finish() -> None:
        found = repeats([lefts[r][i] for r, i, _, _ in group], [n for _, _, n, _ in group], [p for _, _, _, p in group], [bool(many[r][i]) for r, i, _, _ in group], span)
        for (r, i, _, _), ranges in zip(group, found):
            out.extend((sigs[r][16 * i : 16 * i + 16], a, b) for a, b in ranges)

    for r, i, string, prefix in merge(runs):
        if prefix < GRAM and group:
            finish()
            group = []
        group.append((r, i, len(string), prefix))
    if group:
        finish()
    return pd.DataFrame(out, columns=["sig", "first", "last"])


def single_windows(rows: DataFrame, span: int) -> DataFrame:
    """Of ``rows(data, chosen)`` each window of the chosen suffixes: ``sig, offset, window`` (its digest), ``many``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, chosen in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                for c in chosen.as_py():
                    starts = range(c["low"], c["high"] + 1)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array([c["sig"]] * n, pa.binary()), pa.array([c["at"] - s for s in starts], pa.int32()), pa.array([xxhash.xxh3_128_digest(data[s : s + span]) for s in starts], pa.binary()), pa.array([c["many"]] * n, pa.bool_())], ["sig", "offset", "window", "many"])

    return rows.mapInArrow(run, "sig binary, offset int, window binary, many boolean")


def repeated_spans(docs: DataFrame, span: int) -> DataFrame:
    """``kd, th`` and the repeated ``spans`` (array of start and end, not merged) of the documents that have any."""
    rows = texts(docs)
    every = common.written(sampled(rows, span), "anchors")
    # written, so that the join has plain exchanges on both sides and a hot gram's rows can be split
    twice = common.written(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    some = common.written(every.join(twice, "gram", "left_semi"), "candidates")
    common.release(every)
    # one document stands for all that have the same surrounding
    place = F.struct("kd", "th", "at", "low", "high")
    distinct = some.groupBy("gram", "sig").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    distinct = common.written(distinct.select("gram", "sig", (F.col("n") > 1).alias("many"), "p.*"), "suffixes")
    crowded = common.written(distinct.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("gram"), "crowded")
    total, has_crowded = distinct.count(), bool(crowded.limit(1).count())

    def with_text(chosen: DataFrame) -> DataFrame:
        listed = chosen.groupBy("kd", "th").agg(F.collect_list(F.struct("gram", "sig", "many", "at", "low", "high")).alias("chosen"))
        return rows.join(listed, ["kd", "th"]).select("data", "chosen")

    calm = distinct.join(crowded, "gram", "left_anti") if has_crowded else distinct
    runs = sorted_runs(with_text(calm), span, max(1, total // MERGED))
    found = runs.groupBy("part").applyInPandas(lambda frame: merged_repeats(frame, span), "sig binary, first int, last int")
    if has_crowded:
        windows = common.written(single_windows(with_text(distinct.join(crowded, "gram", "left_semi")), span), "windows")
        again = windows.groupBy("window").agg((F.count_distinct("sig") > 1).alias("twice"), F.max("many").alias("many")).filter("twice or many").select("window")
        found = found.unionByName(windows.join(again, "window", "left_semi").select("sig", F.col("offset").alias("first"), F.col("offset").alias("last")).distinct())
    found = common.written(found, "repeats")
    start = F.col("at") - F.col("last")
    spans = some.select("kd", "th", "sig", "at").join(found, "sig").select("kd", "th", F.struct(start.alias("start"), (F.col("at") - F.col("first") + span).alias("end")).alias("s"))
    return common.written(spans.groupBy("kd", "th").agg(F.sort_array(F.collect_set("s")).alias("spans")), "spans")


def kept(data: bytes, spans: list[dict]) -> tuple[bytes, list[dict]]:
    """The bytes outside the spans (sorted by start), and the maximal removed runs."""
    out, at, runs = [], 0, []
    for s in spans or ():
        if not runs or s["start"] > runs[-1]["end"]:
            runs.append({"start": s["start"], "end": s["end"]})
            out.append(data[at : s["start"]])
        else:
            runs[-1]["end"] = max(runs[-1]["end"], s["end"])
        at = runs[-1]["end"]
    out.append(data[at:])
    return b"".join(out), runs


#: What :func:`remove_repeats` can tell of a text, and the types.
RESULTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_sha256": "string", "removed": "array<struct<start:long,end:long>>", "text": "string"}
ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), RESULTS["removed"]: RUNS}


def told(data: bytes, spans: list[dict], results: tuple[str, ...]) -> list:
    """The chosen ``results`` of one text; in ``text`` a character of which a part went goes whole."""
    rest, runs = kept(data, spans)
    of = {"n_bytes": lambda: len(data), "n_removed": lambda: len(data) - len(rest), "n_spans": lambda: len(runs), "kept": lambda: rest}
    of |= {"kept_sha256": lambda: hashlib.sha256(rest).hexdigest(), "removed": lambda: runs, "text": lambda: rest.decode("utf-8", "ignore")}
    return [of[r]() for r in results]


def remove_repeats(docs: DataFrame, span: int = 400, columns: list[str] | None = None, results: tuple[str, ...] = tuple(RESULTS)[:-1]) -> DataFrame:
    """Remove from each text of ``docs(doc_id, text)``, as UTF-8 bytes, what a ``span``-byte string covers that also starts elsewhere.

    Strings don't cross documents; overlaps count; all is judged on the input. Returns the given
    ``columns`` of ``docs`` (default: doc_id) and of ``results`` ``n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``kept`` (binary), ``kept_sha256``, ``removed`` (those runs' starts and ends) and ``text`` (what is left, without
    characters that are cut; only if asked for), in clashes in place of a column of ``docs``.

    Null text counts as empty; texts shorter than ``span`` stay whole; copies remove each
    other; rows that repeat id and text are copies like any other; an empty table gives no rows.

    Only hashes, positions and the suffixes at repeated grams are shuffled besides two joins with the texts.
    Anchors with the same surrounding are one suffix however often they occur, and merges hold about
    ``MERGED`` suffixes; a gram with more than ``CROWDED`` distinct surroundings is judged by
    counting its windows one by one, which aggregates in parallel.
    """
    if span < 2 * GRAM:
        raise ValueError(f"span must be at least {2 * GRAM}")
    columns = ["doc_id"] if columns is None else columns
    plain = [f"c{i}" for i in range(len(columns))]
    spans = repeated_spans(docs, span)
    rows = texts(docs, *(F.col(c).alias(p) for c, p in zip(columns, plain))).join(spans, ["kd", "th"], "left").select(*plain, "data", "spans")
    schema = ", ".join([f"`{p}` {docs.schema[c].dataType.simpleString()}" for c, p in zip(columns, plain)] + [f"{r} {RESULTS[r]}" for r in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(len(plain))).to_pylist()
            for first, last in common.slices(sizes, OUT_BYTES):
                part = batch.slice(first, last - first)
                rows = [told(data.as_py(), found.as_py(), results) for data, found in zip(part.column(len(plain)), part.column(len(plain) + 1))]
                out = [part.column(i) for i in range(len(plain))]
                out += [pa.array(x, ARROW[RESULTS[r]]) for r, x in zip(results, zip(*rows))]
                yield pa.RecordBatch.from_arrays(out, [*plain, *results])

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(p).alias(c) for c, p in zip(columns, plain) if c.lower() not in results), *results)
