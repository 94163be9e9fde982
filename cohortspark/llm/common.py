"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names; without one a local session makes its own, and a
    cluster is an error, since its machines see no folder of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once as Parquet in the shared folder and read back, and where: later plans start from files that outlive
    executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def removed(spark: SparkSession, path: str | None) -> None:
    """The files of a written table go, once what was made from them is written, too."""
    if path is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same for small tables, which Spark removes when nothing refers to them any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (which are counted); beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of an Arrow batch of texts.
TEXT_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose texts are about to go to Python: batches of at most TEXT_ROWS rows from now on in its session, since Spark's
    default of 10,000 texts, held on both sides, is what fills an executor's memory. Bytes are bounded by Spark itself
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so long texts make smaller batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(c: str | Column) -> Column:
    """A string key without nulls: null and every string stay apart."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c))

