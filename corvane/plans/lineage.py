"""Cutting lineage so that it survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary folder of this machine does
    for a local session; on a cluster executors could not read it, so that is an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder_for(spark: SparkSession, name: str = "table") -> str:
    """A new path below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, form: str = "parquet") -> DataFrame:
    """Write ``df`` as a table (or JSON lines) below the checkpoint folder and read that. Its size is then known from its files, whereas a
    checkpoint keeps the estimate of its plan, which each join of a loop multiplies."""
    path = folder_for(df.sparkSession)
    df.write.format(form).save(path)
    return df.sparkSession.read.schema(df.schema).format(form).load(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this session has written to its checkpoint folder. What was cut or written can't be read then."""
    named = spark.sparkContext.getCheckpointDir()
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.sparkContext.setCheckpointDir(named.rsplit("/", 1)[0])
