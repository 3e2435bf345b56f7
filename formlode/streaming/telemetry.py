"""Telemetry of sessions and jobs: roll-ups, transitions, quotas, latest states and incremental learning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up, mean, ratio
from formlode.functions.text import pseudonym


def envelope(events: DataFrame) -> DataFrame:
    """Typed events with hashed user ids; raw values never leave."""
    return events.select("event_id", "ts", pseudonym(F.col("user_id")).alias("user_hash"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def rollup(events: DataFrame, window: str, late: str | None = None) -> DataFrame:
    """Events, errors and value sums for each time window and type; with ``late``, usable on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def transitions(events: DataFrame) -> DataFrame:
    """How often one state follows another within a user's events."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(before.alias("from_state"), F.col("event_type").alias("to_state")).filter("from_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def method_latency(calls: DataFrame) -> DataFrame:
    """Calls, mean and largest latency of each method, and what it extracted of what was expected, in percent."""
    sums = calls.groupBy("method").agg(F.count(F.lit(1)).alias("calls"), mean("latency", 2).alias("avg_latency"), F.max("latency").alias("max_latency"), F.sum("extracted").alias("extracted"), F.sum("expected").alias("expected"))
    return sums.withColumn("yield_pct", half_up(100 * ratio(F.col("extracted"), F.col("expected")), 2))


def completion(events: DataFrame, last: str) -> DataFrame:
    """(day, sessions, completed, completion_pct): sessions that began on each day, and the share that reached the last state."""
    each = events.groupBy("user_id", "session_id").agg(F.min("ts").alias("begun"), F.max((F.col("event_type") == last).cast("int")).alias("done"))
    days = each.groupBy(F.date_format("begun", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("done").alias("completed"))
    return days.withColumn("completion_pct", half_up(100 * ratio(F.col("completed"), F.col("sessions")), 2))


def quota_violations(events: DataFrame, messages: int, sessions: int, calls: int) -> DataFrame:
    """The first limit that each event breaks: messages per session, calls per session, sessions per user and day, in this order.

    events: user_id, session_id, day, ts, event_id, is_call. All limits are counted up to and with the event.
    """
    order = ("ts", "event_id")
    within = Window.partitionBy("user_id", "session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    daily = Window.partitionBy("user_id", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("user_id", "day", "session_id").orderBy(*order)) == 1
    rows = events.withColumn("_new", F.when(first, 1).otherwise(0))
    rows = rows.withColumns({"_m": F.count(F.lit(1)).over(within), "_c": F.count_if("is_call").over(within), "_s": F.sum("_new").over(daily)})
    broken = F.when(F.col("_m") > messages, "messages").when(F.col("_c") > calls, "calls").when(F.col("_s") > sessions, "sessions")
    return rows.withColumn("violated", broken).drop("_new", "_m", "_c", "_s")


def session_latest(events: DataFrame) -> DataFrame:
    """The latest state of each session, and when it was saved."""
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("s")
    return events.groupBy("user_id", "session_id").agg(last).select("user_id", "session_id", F.col("s.event_type").alias("state"), F.col("s.ts").alias("updated_at"))


def job_summary(events: DataFrame) -> DataFrame:
    """Requests, errors, success and duration in seconds of each job."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = micros(F.max("ts")) - micros(F.min("ts"))
    return events.groupBy("user_id", "job").agg(F.count(F.lit(1)).alias("logs"), F.count_if(F.col("event_type") == "click").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.floor(seconds / 1000000).alias("seconds")).withColumn("success", F.col("errors") == 0)


def streamed(source: DataFrame, path: str, mode: str) -> DataFrame:
    """Everything that a finite streaming query gives now, as a table in ``path``: for sources that end, such as a replayed folder.

    Each micro-batch writes a folder of its own, which a repeated batch replaces; nothing passes through the driver.
    """
    spark = source.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    spark.createDataFrame([], source.schema).write.parquet(f"{path}/out/batch=-1")
    running = source.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{path}/out")


def confidence_stream(events: DataFrame, start: float, boost: float, decay: float, top: float, bottom: float) -> DataFrame:
    """Confidence learned incrementally: (vector_id, confidence, steps) after each batch of a stream of events.

    State is one number and a count for each vector. Events of one batch are ordered by time and id, as in the batch fold.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        conf, n = state.get if state.exists else (start, 0)
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            moved = min(conf * boost, top) if e.positive else max(conf * decay, bottom)
            conf, n = int(moved * 1e6 + 0.5) / 1e6, n + 1
        state.update((conf, n))
        yield pd.DataFrame({"vector_id": [key[0]], "confidence": [conf], "steps": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("vector_id").applyInPandasWithState(step, "vector_id long, confidence double, steps int", "confidence double, steps int", "update", GroupStateTimeout.NoTimeout)
