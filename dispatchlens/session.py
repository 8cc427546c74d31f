"""Session helpers: a local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dispatchlens") -> SparkSession:
    """Session for tests and the local benchmark (no UI, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir``.

    On a cluster the directory must be a shared folder named by the cluster in
    ``spark.checkpoint.dir``. Only a local-mode session without that setting
    (tests, local benchmark) gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dispatchlens-ckpt-"))
    return sc.getCheckpointDir()


#: Bytecode that the JVM compiles at most in one method; larger generated ones would be interpreted.
METHOD_BYTES = "8000"


@contextmanager
def compilable(spark: SparkSession) -> Iterator[None]:
    """While it lasts, wide projections are split into methods that the JVM compiles, instead of fused into one that it doesn't."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table", path: str | None = None, by: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder (or to ``path``) and read back.

    Cuts the lineage, survives lost executors and keeps column pruning, filter
    pushdown and file statistics for every later reader. ``by``: partition columns; ``dealt``: the rows lie by them already.
    """
    path = path or f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # rebalanced, so that the number of files follows from the data and not from tasks times partitions
    out = df.hint("rebalance", *by) if by and not dealt else df
    out.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
