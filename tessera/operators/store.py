"""Tables written to the folder that all executors share: lineage ends there and every reader sees one and the same copy."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (one machine, as in tests) a temporary folder becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df, written as Parquet (with the writer's options) and read back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete every table that `stored` wrote in this process; data frames that read them must no longer be used."""
    jvm, n = spark.sparkContext._jvm, len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
