"""One stream of packets to several places at once: a trace of levels, the samples as recorded, the frames' levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenfold.functions.scalars import finite
from lumenfold.operators import stats


def _levels(samples: Column) -> tuple[Column, Column]:
    """Peak and root mean square of an array's finite samples."""
    good = F.filter(F.transform(samples, lambda x: finite(x.cast("double"))), lambda x: x.isNotNull())
    square = F.aggregate(good, F.lit(0.0), lambda a, x: a + x * x)
    return F.array_max(F.transform(good, F.abs)), F.sqrt(square / F.nullif(F.size(good), F.lit(0)))


def traced(packets: DataFrame) -> DataFrame:
    """session_id, the latest packet's seq, peak and level, and all its packets and samples."""
    peak, rms = _levels(F.col("samples"))
    marked = packets.select("session_id", "seq", peak.alias("peak"), stats.dbfs(rms).alias("dbfs"), F.size("samples").cast("long").alias("count"))
    return stats.trace(marked, "session_id", "seq", ["seq", "peak", "dbfs"], "count")


def recorded(packets: DataFrame) -> DataFrame:
    """session_id, start_sample, rate, samples of each packet, once, as a recorder keeps them."""
    return packets.groupBy("session_id", "seq").agg(F.first(F.struct("start_sample", "rate", "samples")).alias("p")).select("session_id", "seq", "p.*")


SINKS: dict[str, Callable[[DataFrame], DataFrame]] = {"trace": traced, "recorder": recorded}


def fan_out(packets: DataFrame, folder: str, checkpoint: str, sinks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataStreamWriter:
    """A stream of packets, each batch of it read once and written to folder by every sink.

    A sink has a folder of its own with a part for each batch. A batch that is
    run again, as after a crash between two sinks, writes its parts over, so
    each sink holds every packet's rows exactly once.
    """
    sinks = SINKS if sinks is None else sinks

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, rows in sinks.items():
                rows(held).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            held.unpersist()

    return packets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def captured(spark: SparkSession, folder: str, sink: str) -> DataFrame:
    """What a sink has written, with the number of the batch."""
    return spark.read.parquet(f"{folder}/{sink}")
