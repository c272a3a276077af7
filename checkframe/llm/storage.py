"""Intermediate results that survive lost executors.

Everything lands in the folder named by ``spark.checkpoint.dir``.  Where that is unset,
a local session gets a temporary folder of its own and any other one a folder in the
warehouse, which its executors share.  An empty result is kept as a table without rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not named:
        set_dir = jsc.getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else _own_dir(spark)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _own_dir(spark: SparkSession) -> str:
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return tempfile.mkdtemp(prefix="checkframe-")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkframe-{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder; later reads never recompute it.

    Parquet takes less room than ``checkpoint()`` and lets later steps read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def kept_bytes(df: DataFrame) -> int:
    """Bytes that a ``cut`` result takes on disk."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


#: Bytes on disk up to which a ``cut`` result is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(kept: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """``view`` (or ``kept``) marked for broadcast if the ``cut`` result it reads is small."""
    view = kept if view is None else view
    return F.broadcast(view) if kept_bytes(kept) <= BROADCAST_BYTES else view


def release(*kept: DataFrame) -> None:
    """Removes the files of ``cut`` results that nothing reads any more."""
    for df in kept:
        remove(df.sparkSession, df._kept_at)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
