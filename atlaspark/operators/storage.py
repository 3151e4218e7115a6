"""Tables in the folder that executors share: cut lineage, and artefacts built once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, each part computed once."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df in spark.sql.shuffle.partitions parts by the columns; what a part costs does not follow from its bytes, so none are joined."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def built_once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None] | None) -> str | None:
    """The folder of an artefact that build(path) writes, built anew only for other inputs: other paths, lengths or times of change. Without build, None if it isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return path, fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()

    key = (spark.sparkContext.applicationId, name, *map(state, inputs))
    if key not in _BUILT and build is not None:
        path = new_path(spark, name)
        build(path)
        _BUILT[key] = path
    return _BUILT.get(key)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df as a table of its own, marked for broadcast only if it has at most so many rows."""
    from pyspark.sql import functions as F

    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df
