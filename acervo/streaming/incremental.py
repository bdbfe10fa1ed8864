"""Incremental processing: what is new, first sightings, merged provenance, windows, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, glob: str, schema, per_batch: int | None = None) -> DataFrame:
    """A stream of parquet files; files already processed are remembered by the checkpoint."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(glob)


def windowed(stream: DataFrame, ts: str, by: list[str], size: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Counts (and sums) per window and group; rows later than ``late`` are let go."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return s.groupBy(F.window("_ts", size).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if value else []))


def first_sightings(stream: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """The first row of every key; state of keys older than ``late`` is dropped."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.dropDuplicatesWithinWatermark([key]).drop("_ts")


def provenance(stream: DataFrame, key: str, source: str) -> DataFrame:
    """``key, sources, n``: for every key the sources seen so far, emitted when they change."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else ("", 0)
        held = set(seen.split("|")) - {""}
        before = len(held)
        for pdf in batches:
            held |= set(pdf[source].dropna())
            n += len(pdf)
        state.update(("|".join(sorted(held)), n))
        if len(held) > before:
            yield pd.DataFrame({key: [k[0]], "sources": ["|".join(sorted(held))], "n": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, source).groupBy(key).applyInPandasWithState(
        update, f"`{key}` {kind}, sources string, n long", "sources string, n long", "update", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into parquet files, and stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over all that is there now through a function of each micro-batch, and stop."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that keeps the last row of every key, one table version per batch.

    A batch that runs again after a failure writes its version again, so nothing counts twice.
    """
    from acervo.operators.joins import last_wins

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_wins(batch, key, order)
        if number > 0:
            new = last_wins(spark.read.parquet(f"{path}/v={number - 1}").unionByName(new, allowMissingColumns=True), key, order)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return each


def history(df: DataFrame, ts: str) -> DataFrame:
    """``day, n, base``: rows of every day and all before it."""
    from pyspark.sql import Window

    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("day", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
