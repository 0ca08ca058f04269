"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):  # tests: one machine, so its folder is shared
        import tempfile

        base = tempfile.mkdtemp(prefix="mdspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: no lineage behind it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df and name int: 1, 2, ... in this order. Ranges are sorted by themselves; only their sizes reach the driver."""
    place = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    held = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(place), "ordered")
    before, starts = 0, []
    for r in held.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts.append((r[0], before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _before bigint")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")
