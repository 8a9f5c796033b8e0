"""C17: work that is done once per key and settings, and a Structured Streaming ingest that keeps only changed documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending(work: DataFrame, done: DataFrame, key: str, fingerprint: str, failed: str = "generation_error") -> DataFrame:
    """Rows of work without a result under these settings; failed ones are tried again. Results of other settings are an error."""
    other = done.where(F.col("fingerprint") != fingerprint)
    if not other.isEmpty():
        raise ValueError("the checkpoint is of a run with other settings")
    finished = done.where(F.col("status") != failed).select(key)
    return work.join(finished, key, "left_anti")


def resume(work: DataFrame, path: str, key: str, fingerprint: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` (adds status) on what is pending, append, and return the last result of each key."""
    spark = work.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    todo = pending(work, spark.read.parquet(path), key, fingerprint) if there else work
    step(todo).withColumns({"fingerprint": F.lit(fingerprint), "at": F.current_timestamp()}).write.mode("append").parquet(path)
    done = spark.read.parquet(path)
    return done.groupBy(key).agg(F.max_by(F.struct(*done.columns), F.struct((F.col("status") != "generation_error").alias("ok"), "at")).alias("r")).select("r.*")


def ingest_changed(spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str, key: str, content: str) -> None:
    """Take in new JSON files once; a row whose content is what the target has last for its key is left out, so a document that
    returns to old content is taken in again. Of several rows of a key in one batch the one with the greatest hash counts, as a
    batch has no order. Exactly once by the checkpoint and a batch folder that a repeated batch overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("content_sha256", F.sha2(F.col(content), 256))
        new = hashed.groupBy(key).agg(F.max_by(F.struct(*hashed.columns), F.coalesce("content_sha256", F.lit(""))).alias("r")).select("r.*")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if number and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(target).where(F.col("batch") < number).groupBy(key).agg(F.max_by(F.struct("content_sha256"), "batch").alias("last"))
            held = old.select(F.col(key).alias("__key"), F.col("last.content_sha256").alias("__sha"))
            new = new.join(held, F.col(key).eqNullSafe(F.col("__key")) & F.col("content_sha256").eqNullSafe(F.col("__sha")), "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
