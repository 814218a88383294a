"""Session-level settings: where intermediate tables live and how large a block is."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT_BLOCK_ROWS = 1 << 18


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, which has no
    second machine to lose, falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lapforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/lapforge-{label}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[list[str]]:
    """Folders of ``new_path`` made in here, by this thread, are deleted when it ends.

    The list names them; one taken off it stays. Nothing may read the others afterwards.
    """
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffle files when they end, not when the driver collects its garbage.

    A write plans its own job, so no other DataFrame reads these files. The session's setting comes back.
    """
    was = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, was)


@contextmanager
def small_arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Jobs run in here hand Python at most ``rows`` rows or about ``size`` bytes at once. The session's settings come back."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage ends here, reads prune columns."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.lapforge.blockRows", str(DEFAULT_BLOCK_ROWS)))


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes (-1 when broadcasting is off)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([kmgt]?)i?b?", text).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")


#: Bytes of a hashed row for a byte of Parquet: the optimiser's estimates are those of the files.
FILE_GROWTH = 8


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df``, by the optimiser's size estimate, is within the broadcast threshold in memory."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) * FILE_GROWTH <= broadcast_limit(df.sparkSession)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles it, unless it is small in memory.

    Well-packed files of millions of rows pass for a table small enough to broadcast, and the
    driver builds every broadcast in its own memory.
    """
    return df if fits_broadcast(df) else df.hint("merge")
