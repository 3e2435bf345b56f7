"""Live forms of quotas, roll-ups, sessions and metric series: state that expires by event time, and sinks that a repeated batch replaces.

State is small and belongs to a session or a user's day, which are dealt to a fixed number of groups by hash, so that a busy user is spread
over groups. A group's rows and state are worked on together, since a call of Python and a visit of the state for each session would take
nearly all the time; within a micro-batch rows are ordered by time and id. Bound a micro-batch at the source (``maxFilesPerTrigger``);
state partitions and groups are fixed by the first run.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from formlode.operators.metrics import LEVELS, metric_series, series_summary

from .telemetry import rollup

DAY_MS = 86_400_000
#: Groups that sessions and users' days are dealt to; those of sessions that never expire are more, so that each stays small.
GROUPS, STORES = 256, 1024
#: Every so many micro-batches a sink of sessions stores all of them, else those that changed.
MERGED = 16
_SESSION, _DAY = ["user_id", "session_id"], ["user_id", "day_no"]
_KNOWN = "user_id IS NOT NULL AND session_id IS NOT NULL AND ts IS NOT NULL"


@contextlib.contextmanager
def state_settings(spark: SparkSession, partitions: int):
    """The state store that processors need, and into how many partitions state is dealt; a running query keeps what it began with."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def replayed(slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], path: str, mode: str, partitions: int, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a streaming query over slices that arrive one after the other, stopping and resuming it from its checkpoint between them.

    Each micro-batch writes a folder of its own below ``path``, which a repeated batch replaces; their rows are returned. With ``sink``,
    that takes the batches instead.
    """
    spark, schema = slices[0].sparkSession, slices[0].schema
    shape = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with state_settings(spark, partitions):
        for part in slices:
            part.write.mode("append").parquet(f"{path}/in")
            out = build(spark.readStream.schema(schema).parquet(f"{path}/in"))
            shape = out.schema
            out.writeStream.foreachBatch(sink or keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return None if sink else spark.read.schema(shape).parquet(f"{path}/out").select(*shape.names)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable").reset_index(drop=True)


def _read(state, names: list[str]) -> pd.DataFrame:
    """The rows of a group's state, which is one Arrow stream: kept row by row, reading it would take longer than all else."""
    body = state.get() if state.exists() else None
    return pa.ipc.open_stream(body[0]).read_pandas() if body else pd.DataFrame(columns=names)


def _held(state, names: list[str], like: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The rows of a state, with keys of the types of ``like``; integers stay exact where a join leaves some out."""
    return _read(state, names).astype({c: like[c].dtype if c in by else "object" if c == "state" else "Int64" for c in names})


def _keep(state, rows: pd.DataFrame) -> None:
    if not len(rows):
        state.clear()
        return
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as sink:
        sink.write_table(table)
    state.update((out.getvalue().to_pybytes(),))


def _joined(df: pd.DataFrame, old: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return df.merge(old, on=by, how="left", sort=False)


def _group(*by: str, groups: int = GROUPS):
    return F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")


class SessionCounts(StatefulProcessor):
    """Running numbers of messages and calls of a group's sessions, and whether an event is its session's first of its day.

    Counts go when a session was idle for ``idle_ms``; a day's mark goes when the watermark has passed its end.
    """

    COUNTS, DAYS = [*_SESSION, "messages_before", "calls_before", "last"], [*_SESSION, "day_no"]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "rows binary")
        self.days = handle.getValueState("days", "rows binary")

    def _store(self, counts: pd.DataFrame, days: pd.DataFrame) -> None:
        _keep(self.counts, counts)
        _keep(self.days, days)
        due = [*(counts["last"] + self.idle_ms), *((days["day_no"] + 1) * DAY_MS)]
        if due:
            self.handle.registerTimer(int(min(due)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, now = _ordered(rows), timerValues.getCurrentWatermarkInMs()
        counts, days = _held(self.counts, self.COUNTS, df, _SESSION), _held(self.days, self.DAYS, df, self.DAYS)
        counts, days = counts[counts["last"] + self.idle_ms > now], days[(days["day_no"] + 1) * DAY_MS > now]
        df = _joined(_joined(df, counts, _SESSION), days.assign(seen=1), self.DAYS)
        own = df.groupby(_SESSION, sort=False)
        df["messages"] = (df["messages_before"].fillna(0) + 1 + own.cumcount()).astype("int64")
        df["calls"] = (df["calls_before"].fillna(0) + df["is_call"].astype("int64").groupby([df[c] for c in _SESSION], sort=False).cumsum()).astype("int64")
        df["starts"] = df["seen"].isna() & ~df.duplicated(self.DAYS)
        ms = df["us"] // 1000
        df["last"] = df["last"].fillna(0).astype("int64").where(df["last"].notna() & (df["last"].fillna(0) > ms), ms)
        df["last"] = df.groupby(_SESSION, sort=False)["last"].cummax()
        ends = df.drop_duplicates(_SESSION, keep="last")[[*_SESSION, "messages", "calls", "last"]].set_axis(self.COUNTS, axis=1)
        counts = pd.concat([counts.astype(ends.dtypes), ends]).drop_duplicates(_SESSION, keep="last")
        self._store(counts, pd.concat([days, df.loc[df["starts"], self.DAYS]]))
        yield df[["user_id", "session_id", "event_id", "ts", "us", "day_no", "messages", "calls", "starts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        counts, days = _read(self.counts, self.COUNTS), _read(self.days, self.DAYS)
        self._store(counts[counts["last"] + self.idle_ms > now], days[(days["day_no"] + 1) * DAY_MS > now])
        return iter(())


class DailySessions(StatefulProcessor):
    """Running numbers of sessions of a group's users and days, and the first limit that an event breaks; a day goes when it has passed."""

    SEEN = [*_DAY, "sessions_before"]

    def __init__(self, messages: int, calls: int, sessions: int):
        self.most = {"messages": messages, "calls": calls, "sessions": sessions}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows binary")

    def _store(self, seen: pd.DataFrame) -> None:
        _keep(self.seen, seen)
        if len(seen):
            self.handle.registerTimer((int(seen["day_no"].min()) + 1) * DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, now = _ordered(rows), timerValues.getCurrentWatermarkInMs()
        seen = _held(self.seen, self.SEEN, df, _DAY)
        seen = seen[(seen["day_no"] + 1) * DAY_MS > now]
        df = _joined(df, seen, _DAY)
        df["sessions"] = (df["sessions_before"].fillna(0) + df["starts"].astype("int64").groupby([df[c] for c in _DAY], sort=False).cumsum()).astype("int64")
        ends = df.drop_duplicates(_DAY, keep="last")[[*_DAY, "sessions"]].set_axis(self.SEEN, axis=1)
        self._store(pd.concat([seen.astype(ends.dtypes), ends]).drop_duplicates(_DAY, keep="last"))
        df["violated"] = None
        for name in reversed(self.most):  # the first of these wins
            df.loc[df[name] > self.most[name], "violated"] = name
        yield df[["user_id", "session_id", "event_id", "ts", "violated"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = _read(self.seen, self.SEEN)
        self._store(seen[(seen["day_no"] + 1) * DAY_MS > timerValues.getCurrentWatermarkInMs()])
        return iter(())


def quota_stream(events: DataFrame, messages: int, sessions: int, calls: int, late: str = "1 hour", idle_days: int = 31) -> DataFrame:
    """(user_id, session_id, event_id, ts, violated) for each event of a stream: the first limit that it breaks, as in the batch form.

    events: user_id, session_id, ts, event_id, is_call. Events without user, session or time are left out, and those later than ``late`` behind the
    latest are dropped. A session's counts start anew after ``idle_days`` without an event. Two chained processors: one for
    sessions, one for users' days, both by groups.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.filter(_KNOWN).select("user_id", "session_id", F.col("ts").cast("timestamp").alias("ts"), us.alias("us"), F.floor(us / (DAY_MS * 1000)).cast("long").alias("day_no"), "event_id", "is_call")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ids = ", ".join(f"{c} {kinds[c]}" for c in ("user_id", "session_id", "event_id"))
    counted = rows.withWatermark("ts", late).withColumn("group", _group(*_SESSION)).groupBy("group").transformWithStateInPandas(
        SessionCounts(idle_days * DAY_MS), f"{ids}, ts timestamp, us long, day_no long, messages long, calls long, starts boolean", "Append", "EventTime", eventTimeColumnName="ts"
    )
    return counted.withColumn("group", _group(*_DAY)).groupBy("group").transformWithStateInPandas(DailySessions(messages, calls, sessions), f"{ids}, ts timestamp, violated string", "Append", "EventTime", eventTimeColumnName="ts")


class SessionStore(StatefulProcessor):
    """A group's sessions: created once, saved by every newer event. What is older than the last save, or equal to it, changes nothing."""

    SAVED = [*_SESSION, "created", "state", "updated", "last_id", "saves"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("sessions", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _ordered(rows).drop_duplicates([*_SESSION, "us", "event_id"])
        old = _held(self.saved, self.SAVED, df, _SESSION)
        df = _joined(df, old.drop(columns="state"), _SESSION)
        known = df["updated"].notna()
        newer = (df["us"] > df["updated"]) | ((df["us"] == df["updated"]) & (df["event_id"] > df["last_id"]))
        df = df[~known | newer.fillna(False)]
        if len(df):
            own = df.groupby(_SESSION, sort=False)
            saves = df["saves"].fillna(0) + own["us"].transform("size")
            made = df["created"].fillna(own["us"].transform("first"))
            ends = df.assign(created=made, updated=df["us"], last_id=df["event_id"], saves=saves).drop_duplicates(_SESSION, keep="last")[self.SAVED]
            ends = ends.astype({c: "int64" for c in ("created", "updated", "last_id", "saves")})
            _keep(self.saved, pd.concat([old.astype(ends.dtypes), ends]).drop_duplicates(_SESSION, keep="last"))
            yield ends.drop(columns="last_id")


def session_store(events: DataFrame) -> DataFrame:
    """(user_id, session_id, created, state, updated, saves) of each session that a micro-batch changes, times in microseconds.

    events: user_id, session_id, ts, event_id, state. The last writer by (ts, event_id) wins, so retries and repeated batches are without
    effect; events without user, session or time are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.filter(_KNOWN).select("user_id", "session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("state").cast("string").alias("state"))
    shape = f"user_id {kinds['user_id']}, session_id {kinds['session_id']}, created long, state string, updated long, saves long"
    return rows.withColumn("group", _group(*_SESSION, groups=STORES)).groupBy("group").transformWithStateInPandas(SessionStore(), shape, "Update", "None")


def _saved(spark: SparkSession, path: str, number: int | None, shape) -> DataFrame:
    """The sessions as stored before the batch of that number, or after all batches; read from the last batch that stored all of them."""
    rows = spark.read.schema(shape).option("basePath", path).parquet(f"{path}/batch=*")
    if number is None:
        number = (rows.agg(F.max("batch")).first()[0] or 0) + 1
    rows = rows.filter((F.col("batch") >= max(0, number - 1) // MERGED * MERGED) & (F.col("batch") < number))
    last = F.max_by(F.struct("created", "state", "updated", "last_id", "saves"), "batch").alias("s")
    return rows.groupBy(*_SESSION).agg(last).select(*_SESSION, "s.*")


def save_sessions(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that does what session_store() does by joins and groupings, for micro-batches of many sessions: no call of Python for each group.

    Batches hold user_id, session_id, ts, event_id, state. Each stores the sessions that it changes, and every MERGED-th all of them, in a
    folder of its own that a repeated batch replaces; a batch reads what was stored since the last that holds all.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.filter(_KNOWN).select(*_SESSION, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("state").cast("string").alias("state"))
        # One shuffle by session serves both groupings and the joins.
        once = own.repartition(*_SESSION).groupBy(*_SESSION, "us", "event_id").agg(F.max("state").alias("state"))
        shape = own.select(*_SESSION, F.col("us").alias("created"), "state", F.col("us").alias("updated"), F.col("event_id").alias("last_id"), F.col("us").alias("saves")).schema.add("batch", IntegerType())
        old = _saved(spark, path, number, shape) if number else spark.createDataFrame([], shape).drop("batch")
        before = old.select(*_SESSION, *[F.col(c).alias(f"_{c}") for c in ("created", "updated", "last_id", "saves")])
        newer = F.col("_updated").isNull() | (F.struct("us", "event_id") > F.struct("_updated", "_last_id"))
        last = F.max(F.struct("us", "event_id", "state")).alias("s")
        ends = once.join(before, _SESSION, "left").filter(newer).groupBy(*_SESSION).agg(F.coalesce(F.first("_created"), F.min("us")).alias("created"), last, (F.coalesce(F.first("_saves"), F.lit(0)) + F.count(F.lit(1))).alias("saves"))
        ends = ends.select(*_SESSION, "created", F.col("s.state").alias("state"), F.col("s.us").alias("updated"), F.col("s.event_id").alias("last_id"), "saves")
        if number and number % MERGED == 0:
            ends = ends.unionByName(old).groupBy(*_SESSION).agg(F.max_by(F.struct(*[c for c in ends.columns if c not in _SESSION]), "saves").alias("s")).select(*_SESSION, "s.*")
        ends.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def saved_sessions(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """What save_sessions() stored, as session_table() gives it. keys: the types of user_id and session_id as a schema."""
    shape = f"{keys}, created long, state string, updated long, last_id long, saves long, batch int"
    return session_table(_saved(spark, path, None, shape))


def session_table(changes: DataFrame) -> DataFrame:
    """The latest of what session_store() gave for each session, with times as such."""
    last = F.max_by(F.struct("created", "state", "updated", "saves"), "saves").alias("s")
    rows = changes.groupBy("user_id", "session_id").agg(last)
    at = lambda c: F.timestamp_micros(F.col(f"s.{c}"))
    return rows.select("user_id", "session_id", at("created").alias("created_at"), F.col("s.state").alias("state"), at("updated").alias("updated_at"), F.col("s.saves").alias("saves"))


def live_rollup(events: DataFrame, window: str, late: str) -> DataFrame:
    """The roll-up of a stream in final form: a window comes out once the watermark has passed its end, and rows of such a window are dropped."""
    return rollup(events.withColumn("ts", F.col("ts").cast("timestamp")), window, late)


def append_series(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends the metrics of a batch to their series on all levels, with the batch's totals beside them.

    Both lie in folders by batch, and a batch that comes again replaces its own only. Each level is written where its rows are: by a shuffle
    the global series, or a level's sort, would be one task's.
    """

    def keep(batch: DataFrame, number: int) -> None:
        entries = metric_series(batch)
        for level, _ in LEVELS:
            entries.filter(F.col("level") == level).drop("level").write.mode("overwrite").parquet(f"{path}/entries/batch={number}/level={level}")
        series_summary(entries).write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    return keep


def series_totals(spark: SparkSession, path: str) -> DataFrame:
    """First, last and number of entries of each series, merged from the batches' totals without reading entries again."""
    rows = spark.read.parquet(f"{path}/totals")
    return rows.groupBy("level", "identifier").agg(F.sum("entries").alias("entries"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("fields").alias("fields"))


def series_entries(spark: SparkSession, path: str, level: str) -> DataFrame:
    """The entries of one level; other levels' files are not opened."""
    return spark.read.parquet(f"{path}/entries").filter(F.col("level") == level)
