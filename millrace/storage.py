"""Tables written to the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: The paths handed out in each call of a tidy function that has not ended yet.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a session in local mode, where driver and executors are one process, may leave it unset; then a folder of this
    process is used and deleted at its end. On a cluster an unset value is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:16]}"
    if _open:
        _open[-1].append(path)
    return path


def read_by(*frames: DataFrame) -> set[str]:
    """The tables of the shared folder that plans read; what a caller has to keep while it uses them."""
    return {f.rsplit("/millrace/", 1)[1].split("/")[0] for df in frames for f in df.inputFiles() if "/millrace/" in f}


def tidy(function: Callable) -> Callable:
    """A function that returns a frame, or a tuple or dict of frames: tables that it wrote and that no returned plan reads are deleted at its end.

    If it fails, all of them are deleted. What remains belongs to the caller; drop_tables() deletes it.
    """

    @functools.wraps(function)
    def run(*args, **kwargs):
        _open.append([])
        spark, keep = None, set()
        try:
            out = function(*args, **kwargs)
            frames = list(out.values()) if isinstance(out, dict) else list(out) if isinstance(out, tuple) else [out]
            frames = [f for f in frames if isinstance(f, DataFrame)]
            keep = read_by(*frames)
            return out
        finally:
            written = _open.pop()
            spark = SparkSession.getActiveSession()
            for path in written:
                if path.rsplit("/", 1)[1] in keep:
                    if _open:
                        _open[-1].append(path)
                elif spark:
                    drop_path(spark, path)

    return run


def drop_tables(*frames: DataFrame) -> None:
    """Deletes the tables of the shared folder that the plans read; the frames cannot be used any more."""
    for name in read_by(*frames):
        drop_path(frames[0].sparkSession, f"{shared_dir(frames[0].sparkSession)}/millrace/{name}")


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Reads a written table with the schema of the frame it was written from; no job to infer it."""
    return spark.read.schema(like.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later plans start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return read_table(df.sparkSession, path, df)


def spread(df: DataFrame) -> DataFrame:
    """df over twice as many tasks as there are cores, if it is smaller than one input split for each core; a larger one as it is.

    A reader gives a file of a single row group to a single task, however many cores wait. What is shuffled for that is at
    most spark.sql.files.maxPartitionBytes a core; the size is the plan's own estimate, which reads nothing.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * split else df


def table_path(df: DataFrame) -> str:
    """The folder of a table that materialize() returned."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
