"""Session plumbing shared by every operator: scratch tables in the shared folder, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is set instead.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all nodes share")
            folder = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{checkpoint_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@contextmanager
def dropping_scratch(spark: SparkSession, keep: list[str] | None = None) -> Iterator[list[str]]:
    """Scratch tables that are made inside are deleted at the end, but for the paths that are put into ``keep``.

    To be used around an action whose result is written elsewhere: what is read lazily must not outlive its tables.
    """
    kept, before = keep if keep is not None else [], len(_scratch)
    yield kept
    for path in _scratch[before:]:
        if path not in kept:
            delete_path(spark, path)
    _scratch[before:] = [p for p in _scratch[before:] if p in kept]


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are deleted as each ends, not when the driver happens to collect its garbage.

    For tables that are written and read back: what is to be executed twice by one reference is not to be made inside.
    """
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, old) if old is not None else spark.conf.unset(SHUFFLE_CLEANUP)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """While an action of ours runs, whole texts reach Python workers at most ``rows`` at a time."""
    old = spark.conf.get(ARROW_ROWS, None)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, old) if old is not None else spark.conf.unset(ARROW_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later stages read committed files, so a lost executor costs only its own
    running tasks, and nothing above is computed twice.
    """
    return write_table(df, scratch_path(df.sparkSession, name))


def write_table(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system layer."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for Python workers to import."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
