"""Helpers shared by the training-data operators: input tables, shared scratch tables, hash samples, components."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.functions import graph
from dispatchlens.session import ensure_checkpoint_dir, written  # noqa: F401  (used by the operators)

#: Characters of text that one step of a vectorised scan works on at a time.
SLICE_CHARS = 1 << 19


#: Rows of an Arrow batch, at most: documents are a few KB, some a hundred.
BATCH_ROWS = 1000
#: Settings of the Python workers' allocator, so that they give large blocks back between stages.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package where the driver has it, and keep them small."""
    env = spark.sparkContext.environment
    for k, v in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), **WORKER_ENV}.items():
        env.setdefault(k, v)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % mod


def hash_fraction(*cols: str | Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def slices(sizes: list[int], most: int = SLICE_CHARS) -> list[tuple[int, int]]:
    """Cut rows 0..n into runs of about ``most`` in total, a larger row alone."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            out.append((start, i))
            start, total = i, 0
        total += s
    if sizes:
        out.append((start, len(sizes)))
    return out


def components(edges: DataFrame, nodes: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """``(node, root)`` of every node, the smallest of its component as root; nodes without an edge are their own."""
    roots = graph.components(edges, a, b).withColumnRenamed("x", node)
    return nodes.select(node).join(roots, node, "left").select(node, F.coalesce("root", F.col(node)).alias("root"))
