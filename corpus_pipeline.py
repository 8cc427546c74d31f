"""A training corpus from raw documents: quality, language, near duplicates, repeated strings, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result into the shared folder and rereads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.llm import common, language, packing, quality, simhash, suffixes


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives label 1 at least even chances, with all their columns.

    A null or empty text has the score of the bias alone; a score of exactly 0.5 stays (so all stay where no label is known);
    repeated rows stay or go together; a null id is no reason to go; whole texts are read, however long; no rows give none."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to a language learnt from them, with all their columns.

    Null, empty and letterless texts go, and all texts go where no language is known; a cosine equal to its limit stays; of equally near
    languages the first in order counts; repeated rows stay or go together; a null id is no reason to go; no rows give none."""
    common.importable(spark)
    return language.keep_told(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked fingerprints."""
    common.importable(spark)
    return simhash.one_of_each(docs, shingle=3)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 400-byte strings (and of characters cut by that); no row goes."""
    common.importable(spark)
    # the operator's own columns can't take the place of a caller's: those go along under other names
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    done = suffixes.remove_repeats(docs.select("text", "doc_id", *(F.col(f"`{c}`").alias(a) for c, a in own.items())), 400, list(own.values()), results=("text",))
    left = {"text": F.col("text")} | {c: F.col(a) for c, a in own.items()}
    if "n_chars" in left:
        left["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*(left[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens."""
    common.importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", packed),
]

#: The stages can't be put in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
