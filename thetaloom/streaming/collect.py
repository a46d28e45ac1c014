"""Results that arrive as files, collected by a file stream with the same classification as the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from thetaloom.operators.work import collected, first_results


def collect_stream(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, files_per_trigger: int | None = None):
    """Start a stream over the JSON files under ``source`` that writes each micro-batch's results under
    ``out/epoch=<n>``. A micro-batch that is repeated after a failure overwrites its own folder, so every result is
    stored once per epoch. There is no watermark: a result may be a day late and still counts."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return reader.json(source).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_results(spark: SparkSession, out: str, schema: StructType, order: str) -> DataFrame:
    """The results stored so far, each request's first one, whichever epochs they came in."""
    return first_results(spark.read.schema(schema).parquet(out).select(*schema.fieldNames()), order)


def outcomes(spark: SparkSession, out: str, schema: StructType, order: str, submitted: DataFrame, requests: DataFrame) -> DataFrame:
    return collected(submitted, requests, stored_results(spark, out, schema, order))
