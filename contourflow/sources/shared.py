"""What several steps read, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a folder of our own, but on one machine only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, parted by columns that later reads choose by. The files go when this process ends.

    Rounds that join what the round before has made must use this, not checkpointed: a checkpoint keeps the estimate of its
    plan, which every such join squares until planning itself takes all the time; of files Spark knows the true size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, *by))


def saved(df: DataFrame, *by: str) -> str:
    """Where written has put df."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    atexit.register(_removed, spark, path)
    return path


#: Spark's option that lets go of what a query has shuffled when it has ended.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def passing(df: DataFrame, *by: str) -> str:
    """As saved, for large tables that go by: what was shuffled for them goes when they are written, and they by removed."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(LET_GO, None)
    conf.set(LET_GO, "true")
    try:
        return saved(df, *by)
    finally:
        if before is None:
            conf.unset(LET_GO)
        else:
            conf.set(LET_GO, before)


def passed(df: DataFrame) -> DataFrame:
    """As written, of passing."""
    return df.sparkSession.read.schema(df.schema).parquet(passing(df))


def removed(spark: SparkSession, path: str) -> None:
    """Removes what saved or passing has put there and nothing reads any more."""
    _removed(spark, path)


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
