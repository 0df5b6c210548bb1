"""Streams: the stateless conversion of rows as they arrive, and count-based windows over numbered quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.operators import c2r
from quadloom.plans.descriptor import Table


def stream_quads(rows: DataFrame, table: Table, ordinal: int = 0, options: c2r.Options = c2r.Options(minimal=True)) -> DataFrame:
    """Quads of a streaming (or batch) DataFrame with columns _c0.. and _row: the same narrow projection, no state."""
    return c2r.row_quads(rows, table, ordinal, options)


def window_step(size: int) -> int:
    return max(size // 10, 1)


def window_events(quads: DataFrame, size: int, number: str = "n") -> DataFrame:
    """For quads numbered from 0: the first and last window that holds each. Window k holds [k * step, k * step + size)."""
    step, n = window_step(size), F.col(number)
    first = F.greatest(F.lit(0), F.expr(f"({number} - {size} + {step}) div {step}")).cast("bigint")
    return quads.withColumn("added_at", F.when(n < size, F.lit(0)).otherwise(first).cast("bigint")).withColumn("last_at", F.expr(f"{number} div {step}").cast("bigint"))


def materialised(stream: DataFrame, name: str) -> DataFrame:
    """Runs a finite stream to its end (available now) into the shared folder and gives the result back."""
    spark = stream.sparkSession
    path = runtime.scratch_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
