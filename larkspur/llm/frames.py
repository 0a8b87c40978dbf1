"""DataFrame helpers of this subpackage, beside those of ``larkspur.frames``."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from larkspur.frames import cut, delete_path, is_small, join_small, scratch_path, shared_dir, small_batches

__all__ = ["cut", "delete_path", "is_small", "join_small", "release", "scratch_path", "shared_dir", "shuffle_width", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete files of shuffles, broadcasts and checkpoints that nothing refers to; else they stay until the driver happens to collect its garbage.

    What the last query holds is only let go a little after it, in a second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)  # what a query has sent is let go a little after it has ended
