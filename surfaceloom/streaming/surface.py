"""Deduplication of a stream of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surfaceloom.operators.dedup import dedup, first_arrivals, keyed
from surfaceloom.options import SurfaceOptions


def on_sight(stream: DataFrame, options: SurfaceOptions) -> DataFrame:
    """out of every signature once, in append mode; which of the lines of one micro-batch stands for it is open."""
    if options.merging:
        raise ValueError("a later line can remove an earlier one; use first_seen or refresh")
    return keyed(stream, "line", options).dropDuplicates(["sig"]).select("out")


def first_seen(stream: DataFrame, path: str, checkpoint: str, options: SurfaceOptions, ord_col: str = "ord") -> StreamingQuery:
    """Appends ord, sig and out of every signature's first arrival to the table at path.

    Each micro-batch is deduplicated as a batch and held against the table, which is all the state there is.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = first_arrivals(keyed(batch, "line", options), ord_col).select(ord_col, "sig", "out")
        if _exists(spark, path):
            # a batch that is run again finds only what earlier batches wrote
            rows = rows.join(spark.read.parquet(path).where(F.col("batch") < number).select("sig"), "sig", "left_anti")
        rows.select(ord_col, "sig", "out").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(stream: DataFrame, lines: str, path: str, checkpoint: str, options: SurfaceOptions = SurfaceOptions(), ord_col: str = "ord") -> StreamingQuery:
    """Keeps all lines so far at `lines`, and at `path` what a batch run over them keeps, written anew each time."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(ord_col, "line").write.mode("overwrite").parquet(f"{lines}/batch={number}")
        dedup(spark.read.parquet(lines), "line", ord_col, options).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
