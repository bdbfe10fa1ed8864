"""Queries over the event stream and its batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from acervo.plans.registry import query
from acervo.runtime import checkpoint_dir, ship, table
from acervo.streaming import incremental as S


def _events(spark, d):
    ship(spark)
    return S.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


def _places(spark):
    root = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


@query(
    "stream_windows",
    """select date_trunc('hour', ts) as start, event_type, count(*) as n from events
    where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 2 hour from events) group by 1, 2""",
)
def stream_windows(spark, d):
    """Hourly counts of closed windows, run as a stream to its end."""
    out, state = _places(spark)
    S.drain(S.windowed(_events(spark, d), "ts", ["event_type"]), out, state)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_users", "select user_id from events group by user_id")
def stream_users(spark, d):
    """Users at their first sighting, run as a stream to its end."""
    out, state = _places(spark)
    S.drain(S.first_sightings(_events(spark, d), "user_id", "ts", "3650 days"), out, state)
    return spark.read.parquet(out).select("user_id")


@query("stream_latest", "select user_id, max(ts) as ts from events group by user_id")
def stream_latest(spark, d):
    """The last event of every user, kept by an upsert of each micro-batch."""
    out, state = _places(spark)
    S.drain_batches(_events(spark, d).select("user_id", "ts", "event_id"), S.upsert_into(out, "user_id", "ts"), state, "append")
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("v")).first()[0]
    return rows.where(F.col("v") == last).select("user_id", "ts")


@query("stream_provenance", "select user_id, string_agg(distinct event_type, '|' order by event_type) as sources from events group by user_id")
def stream_provenance(spark, d):
    """For every user the kinds of event seen, held as state of the stream."""
    out, state = _places(spark)

    def each(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    S.drain_batches(S.provenance(_events(spark, d), "user_id", "event_type"), each, state)
    return spark.read.parquet(out).groupBy("user_id").agg(F.max_by("sources", F.length("sources")).alias("sources"))


@query("daily_history", "select ts::date as day, count(*) as n, coalesce(sum(count(*)) over (order by ts::date rows between unbounded preceding and 1 preceding), 0)::bigint as base from events group by 1")
def daily_history(spark, d):
    return S.history(table(spark, d, "events"), "ts")


@query("latest_slice", "select record_id, max(ingested_at) as ingested_at from master_records where first_seen_date = (select max(first_seen_date) from master_records) group by record_id")
def latest_slice(spark, d):
    """Records first seen on the last day."""
    r = table(spark, d, "master_records")
    last = r.agg(F.max("first_seen_date").alias("first_seen_date"))
    return r.join(F.broadcast(last), "first_seen_date").groupBy("record_id").agg(F.max("ingested_at").alias("ingested_at"))


@query("late_records", "select record_id, max(date_diff('day', first_seen_date::timestamp, ingested_at)) as days_late from master_records where ingested_at > first_seen_date + interval 30 day group by record_id")
def late_records(spark, d):
    r = table(spark, d, "master_records").where("ingested_at > cast(first_seen_date as timestamp_ntz) + interval 30 day")
    return r.groupBy("record_id").agg(F.max(F.datediff(F.to_date("ingested_at"), "first_seen_date")).cast("bigint").alias("days_late"))
