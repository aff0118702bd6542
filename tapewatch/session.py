"""Session settings and the shared folder for lineage cuts and streaming state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapewatch", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession) -> str:
    """A new sub-folder of the shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="tapewatch-")
    path = f"{shared.rstrip('/')}/tapewatch-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Notes every folder that ``workspace`` names inside the block, for ``discard``."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [m for m in _OPEN if m is not made]


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of the folders that are there, on whatever store."""
    found = []
    for folder in folders:
        store, path = _store(spark, folder)
        if store.exists(path):
            found.append(folder)
    return found


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes noted folders; nothing that reads them may be evaluated any more."""
    while folders:
        store, path = _store(spark, folders.pop())
        store.delete(path, True)


#: Spark deletes the shuffle files of a query as soon as it has ended, not when the driver happens to collect garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before) if before is not None else spark.conf.unset(SWEEP)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Used where an iterative or multi-pass step would otherwise recompute its input.
    The files outlive a lost executor. Shuffles of the write are deleted once it is done.
    """
    path = f"{workspace(df.sparkSession)}/{name}"
    with _swept(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
