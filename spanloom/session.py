"""Session helpers: the shared folder, written-and-reread tables, removal of temporary paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session that runs in this process alone gets a temporary folder if it names none; on a
    cluster such a folder would be another one on each machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = context.getCheckpointDir()
        if not chosen:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
            chosen = context.getCheckpointDir()
        return str(chosen).rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def parts_of(spark: SparkSession, amount: int, per: int) -> int:
    """Into how many parts so many rows or bytes go, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-amount // per))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def mark() -> int:
    """A point in time for :func:`sweep`."""
    return len(_made)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes what :func:`stored` has written since a mark, but for keep: the caller knows that no other
    frame of that time is read any more."""
    left = getattr(keep, "_spanloom_path", None)
    for path in _made[since:]:
        if path != left:
            remove(spark, path)
    _made[since:] = [left] if left in _made[since:] else []


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there,
    and the rows outlive any executor. With parts, at most so many files are written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _made.append(path)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._spanloom_path = path
    return again


def discard(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by :func:`stored`, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_spanloom_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def once(c: Column) -> Column:
    """c, made by a generator (one a select): filters and columns above it read the value, where the optimizer would
    copy the expression into each of them, and with it all that it is made of."""
    return F.explode(F.array(c))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over the cores where a scan gives fewer parts than there are cores, so that costly
    expressions above it do not run in a few tasks; a table of many parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
