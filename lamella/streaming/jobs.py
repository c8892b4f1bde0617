"""Running streams: to completion into tables, with retries, exactly once by content."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only in local mode, where driver and tasks are one process, a temporary folder stands in for a
    missing setting; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lamella-")
        sc.setCheckpointDir(named)
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is available and return the output as a table.

    Each micro-batch overwrites a folder of its own, so a batch that is run again after a
    failure leaves its rows once.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/out/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").drop("batch")


def once(batch: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a batch whose (path, size, mtime) no earlier run has finished."""
    return batch.dropDuplicates(["path", "size", "mtime"]).join(manifest.filter("status = 'OK'").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def with_retries(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], attempts: int = 3, delay: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Run jobs (with a ``key`` column) and try the failed ones again after ``delay`` seconds; returns done and dead-letter tables.

    ``run`` returns the jobs with a boolean ``ok``. Attempts are whole passes over what has
    failed, so a pass is one distributed job whatever the number of keys.
    """
    spark, root = jobs.sparkSession, shared_folder(jobs.sparkSession)
    left, done = jobs, None
    for n in range(attempts):
        run(left).withColumn("attempt", F.lit(n + 1)).write.parquet(f"{root}/try={n}")
        tried = spark.read.parquet(f"{root}/try={n}")
        good = tried.filter("ok")
        done = good if done is None else done.unionByName(good)
        left = tried.filter("NOT ok").drop("ok", "attempt")
        if left.isEmpty():
            break
        if n + 1 < attempts:
            time.sleep(delay)
    return done, left


def with_metadata(files: DataFrame, params: DataFrame, manual: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with the parameters of their own folder, and those that must wait; manual values override."""
    joined = files.join(params.withColumn("_known", F.lit(True)), "folder", "left")
    for k, v in (manual or {}).items():
        joined = joined.withColumn(k, F.lit(v))
    return joined.filter("_known").drop("_known"), joined.filter("_known IS NULL").select(files.columns)
