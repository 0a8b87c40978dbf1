"""DataFrames kept in the folder that all executors share, and joins with tables whose size is counted."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named a local one is set in local mode; on a cluster, whose
    executors share no local folder, that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="larkspur-checkpoint-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that its lineage ends there.

    Spark removes the files when the frame is no longer referenced (if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a table that is sent to every task; larger ones meet by a shuffle.
MOST_BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> bool:
    """Whether ``df``, of which no more than ``most`` rows are counted, may be sent to every task."""
    return df.limit(most + 1).count() <= most


def join_small(rows: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that is expected to be small; its size is counted first.

    ``small`` has a few narrow columns.  Beyond the bound the join is a sort-merge
    join, whose skewed keys adaptive execution splits.
    """
    return rows.join(F.broadcast(small) if is_small(small) else small.hint("merge"), on, how)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BYTES = 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after Arrow batches have been limited to 8 MB unless the session sets a limit of its own.

    Whole texts travel in these batches, which both the executor and its Python
    workers hold outside Spark's memory management.  The limit is read when the
    plan runs, so it stays set for the session.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES).rstrip("bB") == str(_DEFAULT_BYTES):
        conf.set(_BATCH_BYTES, str(8 << 20))
    return df
