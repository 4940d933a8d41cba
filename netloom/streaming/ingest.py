"""Layers fed by a stream: late and repeated rows are dealt with by watermark, state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_arcs(stream: DataFrame, *, at: str = "at", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window, src, dst, value, arcs) from a stream of (row_id, src, dst, value, at): sums per pair and time window.

    A row delivered again within `late` counts once; rows with a null end or value are left out; rows later than `late`
    are dropped, which is what bounds the state.
    """
    rows = stream.where("src is not null and dst is not null and value is not null").withWatermark(at, late)
    rows = rows.dropDuplicatesWithinWatermark(["row_id"])
    sums = rows.groupBy(F.window(at, width).alias("window"), "src", "dst").agg(F.sum("value").alias("value"), F.count("*").alias("arcs"))
    return sums


def append_layer(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends arcs to a layer kept as Parquet, exactly once for each batch."""
    columns = stream.select("src", "dst", F.col("value").cast("float").alias("value"))
    return columns.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
