"""Restartable and streaming forms of the finding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.joins import pending


def resume(files: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Files that no marker says are done."""
    return pending(files, processed, key)


def mark(done: DataFrame, path: str) -> None:
    """Appends markers (a path column) to the table of finished files."""
    done.select("path").write.mode("append").parquet(path)


def stream_findings(spark: SparkSession, source: str, schema, out: str, checkpoint: str, late: str = "40 days"):
    """Starts a query that takes new reports from source and keeps counts per rule in out.

    Findings are deduplicated on (path, rule, line) within the watermark. Each batch adds
    its counts under its own number, so a batch run again replaces what it wrote before.
    """
    rows = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    fresh = rows.dropDuplicatesWithinWatermark(["path", "rule", "line"])

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("rule").agg(F.sum("n").alias("n"))
