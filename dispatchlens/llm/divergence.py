"""Source divergence audit: how the sources of a language differ in the terms they use.

Each language's kept terms are numbered within blocks, and each group (a language's source) has one slice of
smoothed frequencies a term block. The work is a cube: a task owns a cell (group block, group block, term
block), gets the two group blocks' slices of that term block, and sums the absolute differences of
every pair of groups in it. Slices are replicated to the cells along the group axes only; the cells' partial sums are
added up along the term axis.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common

#: A term: a run of ASCII letters and of characters beyond ASCII, in UTF-8 after lower-casing A-Z.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task counts before it hands them on.
COUNTED = 300_000
#: Groups and terms along the sides of a cell, about: two dense blocks of 8 MB.
GROUP_BLOCK, TERM_BLOCK = 32, 1 << 15
GROUP = ["lang", "source"]
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, partly added up; every group also has a row of term ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each group, occurrences and documents by term; both take a text's terms in the same order
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in found.items():
                terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *in_docs.values()], pa.int64())], ["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            langs, sources, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            size = sum(len(n) for n, _ in found.values())
            for i, group in enumerate(zip(langs, sources)):
                n, in_docs = found.setdefault(group, (Counter(), Counter()))
                terms = TERM.findall(column[i].as_py().lower())  # bytes.lower() changes A-Z alone
                size -= len(n)
                n.update(terms)
                in_docs.update(dict.fromkeys(terms, 1))
                size += len(n)
                if size > COUNTED:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTS)


def share(n: Column, all_n: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (n + 5) / (all_n + 5 terms))``, exactly also where the product is beyond 64 bits."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    top, bottom = F.lit(1_000_000_000).cast("decimal(10,0)") * whole(n + 5, 19), whole(all_n + 5 * terms, 19)
    return (F.call_function("div", top, bottom) + 1).cast("long")


def blocked(kept: DataFrame, block: int) -> DataFrame:
    """``kept(lang, term, ...)`` with the term's block (of about ``block`` terms), its place there and the block's size."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n")).withColumn("blocks", F.ceil(F.col("terms") / block))
    # written, so that the window isn't computed by language alone after the join
    own = common.written(kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")), "blocked")
    within = Window.partitionBy("lang", "block")  # about ``block`` terms
    return own.withColumn("place", F.row_number().over(within.orderBy("term")) - 1).withColumn("size", F.count("*").over(within))


def differences(frame: pd.DataFrame) -> pd.DataFrame:
    """One cell: the sum over its terms of the absolute differences, for each pair of a group of the one block and a group of the other (each pair once).

    Rows come in any order; a pair's groups are always told in the same one, so that the cells of all term blocks add up."""
    size = int(frame["size"].iloc[0])

    def block(at: int) -> tuple[list[str], np.ndarray]:
        rows = frame[frame["group_block"] == at].sort_values("source")
        dense = np.repeat(rows["absent"].to_numpy(np.int64)[:, None], size, axis=1)
        for row, places, shares in zip(dense, rows["places"], rows["shares"]):
            row[places] = shares
        return rows["source"].tolist(), dense

    a, b = int(frame["a_block"].iloc[0]), int(frame["b_block"].iloc[0])
    left, x = block(a)
    right, y = (left, x) if a == b else block(b)
    firsts, seconds, values = [], [], []
    for i, source in enumerate(left):
        after = i + 1 if a == b else 0
        firsts += [source] * (len(right) - after)
        seconds += right[after:]
        values += np.abs(y[after:] - x[i]).sum(axis=1).tolist()
    columns = {"lang": [frame["lang"].iloc[0]] * len(values), "a": firsts, "b": seconds}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()} | {"value": pd.Series(values, dtype="int64")})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs(text, lang, source)``.

    A language keeps the terms in at least ``least_docs`` of its documents. Smoothed frequencies of a group and of
    a language are ``p = 1 + floor(10^9 (n + 5) / (N + 5 V))`` over its V kept terms. Part ``pair``: every other source of the
    language and the sum of ``|p - q|`` over the kept terms. Part ``term``: the ``top`` kept terms that
    occur in the group and are more frequent there than in the language, by ``p - q``. Ranks start at 1
    for each group and part; ties go to the item first in UTF-8.

    Null text, lang and source count as empty strings. Groups without kept terms, and languages that keep
    none (all values 0), have their pairs. A language with one source has no pairs; an empty table gives no rows. Repeated
    rows are documents of their own; other columns are not read.

    Texts are scanned once and counted within tasks; counts are written before they are joined, so that a
    frequent term or a large group is split. Windows and cells hold one block of terms, one language's list of
    sources (whose square is the result), or one group's result.
    """
    partial = term_counts(docs)
    counts = common.written(partial.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    is_term = F.col("term") != ""
    by_term = counts.filter(is_term).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = blocked(by_term.drop("docs"), term_block).withColumn("q", share(F.col("n"), F.col("lang_n"), F.col("terms")))
    terms = common.written(terms.drop("n", "lang_n"), "kept-terms")
    used = common.written(counts.filter(is_term & (F.col("n") > 0)).drop("docs").join(terms, ["lang", "term"]), "used-terms")

    langs = terms.groupBy("lang").agg(F.first("terms").alias("terms"), F.first("blocks").alias("blocks"))
    sizes = terms.groupBy("lang", "block").agg(F.first("size").alias("size"))
    sums = used.groupBy(*GROUP).agg(F.sum("n").alias("group_n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.filter(~is_term).select(*GROUP).withColumn("group_block", F.floor(number / group_block))
    zero = lambda c, n=0: F.coalesce(F.col(c), F.lit(n)).alias(c)
    groups = groups.join(langs, "lang", "left").join(sums, GROUP, "left").select(*GROUP, "group_block", zero("terms"), zero("blocks", 1), zero("group_n"))
    groups = common.written(groups, "groups")

    told = used.drop("terms", "blocks", "size").join(groups, GROUP)
    told = common.written(told.select(*GROUP, "term", "block", "place", "q", share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p")), "shares")
    slices = told.groupBy(*GROUP, "block").agg(F.collect_list(F.struct("place", "p")).alias("own")).select(*GROUP, "block", F.col("own.place").alias("places"), F.col("own.p").alias("shares"))
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("group_n"), F.expr("greatest(terms, 1)"))).otherwise(0).alias("absent")
    spread = groups.select(*GROUP, "group_block", absent, F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    whole = spread.join(slices, [*GROUP, "block"], "left").join(sizes, ["lang", "block"], "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    whole = whole.select(*GROUP, "group_block", "absent", "block", zero("size"), F.coalesce("places", none("int")).alias("places"), F.coalesce("shares", none("long")).alias("shares"))

    last = groups.groupBy("lang").agg(F.max("group_block").alias("last"))
    cells = whole.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    cells = cells.withColumn("a_block", F.least("group_block", "other")).withColumn("b_block", F.greatest("group_block", "other")).drop("other", "last")
    partial = cells.groupBy("lang", "a_block", "b_block", "block").applyInPandas(differences, "lang string, a string, b string, value long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    marked = told.filter(F.col("p") > F.col("q")).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(marked)
