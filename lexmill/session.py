"""Session helpers: defaults for own sessions, and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings of sessions that this library starts itself; a session handed in is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, the command line and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lexmill")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "12g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop: local master) is a temporary folder chosen; on a
    cluster without it an error is raised, since a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), f"lexmill-{os.getpid()}")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and held in the shared folder (reliable checkpoint, lineage cut)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def task_count(df: DataFrame) -> int:
    """Partitions for work that is bound by the CPU: two a core, or spark.sql.shuffle.partitions, if that is more."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scan_tasks(df: DataFrame) -> int:
    """Tasks that reading the sources of ``df`` takes, from their files and sizes: nothing of the plan is run."""
    files = len(df.inputFiles())
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
        return max(files, -(-size // df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    except Exception:  # sessions that show no plan: a task per file at least
        return files


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over enough tasks for CPU-bound work: as it is if its sources are read by a task per core, else
    repartitioned by ``keys`` (a hash, so that a lost task can be done again with the same rows)."""
    if scan_tasks(df) >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(task_count(df), *keys)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every query run within go as soon as it ends, instead of when the driver happens to collect
    its garbage. The session's own setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Tables written so far and not yet removed.
_TABLES: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Unlike a checkpoint it keeps columns apart, so that later passes read only what they need. The table stays
    until ``discard``, ``release`` or the end of the interpreter; what was shuffled for it goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(release, spark)
    _TABLES.add(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.parquet(path)
    table.stored_at = path
    return table


def is_stored(table: DataFrame) -> bool:
    """Whether ``table`` is one that ``stored`` has written and that is still there."""
    return getattr(table, "stored_at", None) in _TABLES


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` has written and nothing will read again, such as those of a loop's last round."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path in _TABLES:
            _remove(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables. For long-lived drivers, between queries whose results have been taken."""
    for path in sorted(_TABLES):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    _TABLES.discard(path)
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already; the cluster's own clean-up takes over
        pass
