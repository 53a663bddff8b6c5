"""Long runs that go on where they stopped, and yes-rates of verdicts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragloom.operators import versioning


def done(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Ids that an output folder has; none where it isn't there yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path).select("record_id") if there else like.select("record_id").where("false")


def resumed(records: DataFrame, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Work on records that the output lacks, append, and return all of the output. The output's commits are the checkpoint."""
    spark = records.sparkSession
    todo = versioning.pending(records, done(spark, path, records))
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stream(source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's new records are worked on once: a batch that is repeated after a failure skips what was written."""

    def step(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["record_id"])
        todo = versioning.pending(fresh, done(batch.sparkSession, path, fresh))
        work(todo).write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_yes_rates(verdicts: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Yes-rates of each question by window; verdicts later than the watermark don't count."""
    grouped = verdicts.withWatermark(time, late).groupBy(F.window(time, width), "question_id")
    return grouped.agg(F.count("*").alias("n"), F.avg(F.col("verdict").cast("double")).alias("yes_rate"))
