"""Growing folders of records as streams: resumable appends and running label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is new and stop; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def label_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of labels (id, labels, time) in tumbling windows; rows later than `late` are dropped, as a watermark does."""
    rows = stream.withWatermark(time, late).select(time, F.explode("labels").alias("label"))
    return rows.groupBy(F.window(time, window).alias("window"), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "label", "n")
