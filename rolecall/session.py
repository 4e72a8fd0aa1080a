"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of ids (8 bytes each) that may be broadcast; above it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Tables staged by this process and not yet dropped.
_STAGED: list[str] = []


def build_session(app: str = "rolecall", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Whoever sets it says that driver and executors share it; its name doesn't tell, since a
    plain path or one below ``/tmp`` may be a mount. A local session without the setting
    (tests, a laptop) gets a fresh folder of its own; a cluster without it is an error,
    because a machine-local folder would lose the data together with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="rolecall-")
    context.setCheckpointDir(own)
    return own


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def file_versions(spark: SparkSession, *tables: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file that ``tables`` read; files that are gone are left out."""
    found = []
    for path in sorted({path for df in tables for path in df.inputFiles()}):
        files, place = file_system(spark, path)
        if files.exists(place):
            status = files.getFileStatus(place)
            found.append((path, status.getLen(), status.getModificationTime()))
    return found


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table, or an empty one where nothing has been written yet."""
    files, place = file_system(spark, path)
    if files.exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables this process has staged, or those after the first ``since``; call it once their results are written."""
    while len(_STAGED) > since:
        files, place = file_system(spark, _STAGED.pop())
        files.delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end; write the result before it ends."""
    since = len(_STAGED)
    try:
        yield
    finally:
        drop_staged(spark, since)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path right in the shared folder: a folder in between would belong to the first user who made it."""
    return os.path.join(shared_dir(spark), f"rolecall-{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    whole job) and gives the optimizer true file sizes for its join choice.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
