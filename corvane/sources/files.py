"""Files as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import QUESTION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """One object a line; blank lines are no rows."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json(F.trim("value"), schema).alias("x")).select("x.*")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="corvane-")


def materialised(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so that what made them runs once and a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder, for what is read more than once by column; its owner empties the folder."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
