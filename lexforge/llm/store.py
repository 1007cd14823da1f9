"""Files and intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and Spark runs within one
process (tests on one machine) a folder of the driver's is made and used; on a cluster an unset folder is an error, as
executors would not see each other's files. Tables written here cut lineage: they survive the loss of any executor.
All of them are below one folder for each application, which ``discard`` removes.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}

#: Rows up to which a small table (one row for a group, a rule, a source) may be broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 20_000


def _base(spark: SparkSession) -> str:
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _UNSET:
            made = tempfile.mkdtemp(prefix="lexforge-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _UNSET[app] = f"file://{made}"
        base = _UNSET[app]
    return f"{base.rstrip('/')}/lexforge-{app}"


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below the shared one."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove all that this application has written here; DataFrames read from it can't be used any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of the batches in which texts go to Python while a table is written; Spark's default of 10,000 rows
#: holds tens of MB of texts, in several copies, in each task.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs within; the session's own settings come back after it, and smaller ones stay."""
    conf, before = spark.conf, {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            before[key] = now
            conf.set(key, str(most))
    try:
        yield
    finally:
        for key, was in before.items():
            conf.unset(key) if was is None else conf.set(key, was)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written small table, with a broadcast hint if and only if its counted rows are within ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def filesystem(uri: str):
    """pyarrow's file system and the path in it; works for any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def commit_file(uri: str, write) -> None:
    """Call ``write(stream)`` on a file of this attempt's own and rename it to ``uri``, so that readers see whole files
    only and a task that runs twice leaves one."""
    files, path = filesystem(uri)
    folder = path.rsplit("/", 1)[0]
    files.create_dir(folder, recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, path)
