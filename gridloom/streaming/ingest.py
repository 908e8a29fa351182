"""Month-by-month ingest as a stream over files: resumable by checkpoint, idempotent by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import mask_scale


def ingest_months(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> None:
    """Everything new under ``source`` is masked, scaled and written by month; a repeated batch replaces itself.

    A batch's rows go to folders of its own within each month, so a batch that is run again after a failure overwrites
    only what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        out = mask_scale(batch).withColumns({"month": F.date_format("obs_date", "yyyy-MM"), "batch": F.lit(number)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
