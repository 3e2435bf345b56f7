"""Typed telemetry: one stream of raw events, parsed by type, with hashed ids and the context of the document; what doesn't fit is set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formlode.functions.rounding import half_up
from formlode.functions.text import pseudonym

# The event types and the fields of their payloads; those in OPTIONAL have a default.
PAYLOADS = {
    "extraction_result": "fields_extracted long, fields_attempted long, latency double, method string, prompt_version string, hallucination_detected boolean",
    "state_transition": "from_state string, to_state string, turn_number long, latency double",
    "session_complete": "total_turns long, duration_seconds double, mandatory_pct double, optional_pct double",
}
OPTIONAL = {"prompt_version": "v1", "hallucination_detected": False}
#: The kind of the rows that are set apart.
QUARANTINE = "quarantine"
RAW = "event_id long, ts timestamp, user_id string, session_id string, document_id long, event_type string, payload string"
TYPED = (
    "event_id long, ts timestamp, user_id_hash string, session_id_hash string, document_id long, kind string, reason string, payload string, "
    "fields_extracted long, fields_attempted long, latency_ms long, method string, prompt_version string, hallucination_detected boolean, from_state string, to_state string, "
    "turn_number long, total_turns long, duration_seconds double, mandatory_completion_pct double, optional_completion_pct double"
)


def _named(kind: str) -> list[tuple[str, str]]:
    return [tuple(field.split()) for field in PAYLOADS[kind].split(", ")]


def _given(kind: str) -> Column:
    """Whether the parsed payload has every field without a default; numbers must be finite."""
    have = F.lit(True)
    for name, of in _named(kind):
        if name not in OPTIONAL:
            x = F.col(f"`_{kind}`.{name}")
            have &= x.isNotNull() & (F.abs(x) < float("inf") if of == "double" else F.lit(True))
    return have


def _field(name: str) -> Column:
    """The field of whichever payload has it, for rows that are kept."""
    found = [F.when(F.col("kind") == kind, F.col(f"`_{kind}`.{name}")) for kind in PAYLOADS if name in dict(_named(kind))]
    x = F.coalesce(*found)
    if name in OPTIONAL:
        holds = [k for k in PAYLOADS if name in dict(_named(k))]
        x = F.when(F.col("kind").isin(holds), F.coalesce(x, F.lit(OPTIONAL[name])))
    return x


def _hashed(name: str) -> Column:
    return F.when(F.col(name) != "", pseudonym(F.col(name)))


def typed_events(raw: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Rows of TYPED, and the columns of ``contexts``, for each row of ``raw`` (columns of RAW); also on a stream.

    kind is the event type, or QUARANTINE with a reason, the first that holds: ``time`` (null ts), ``type`` (null or unknown event type),
    ``json`` (the payload is null or no object), ``field`` (a field is missing, null, of another type or not finite). Only these keep
    their payload. User and session ids are hashed, null and empty ones give null. Latency is in whole milliseconds, cut;
    durations have one digit, percentages two. contexts has one row for each document_id; of several, the least in the order of its
    columns counts. Events of an unknown or null document have null context. Columns of ``raw`` beyond RAW are dropped, repeated rows
    stay. The join with ``contexts`` is one of a stream with a static table: Spark broadcasts it only if it is small.
    """
    known = raw.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RAW.split(", ")])
    rows = known.withColumns({f"_{kind}": F.when(F.col("event_type") == kind, F.from_json("payload", fields)) for kind, fields in PAYLOADS.items()})
    parsed = F.try_parse_json("payload")
    broken = parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    lacking = F.lit(False)
    for kind in PAYLOADS:
        lacking |= (F.col("event_type") == kind) & ~F.coalesce(_given(kind), F.lit(False))
    unknown = ~F.coalesce(F.col("event_type").isin(list(PAYLOADS)), F.lit(False))
    reason = F.when(F.col("ts").isNull(), "time").when(unknown, "type").when(broken, "json").when(lacking, "field")
    rows = rows.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), F.col("event_type")).otherwise(QUARANTINE))
    out = rows.select(
        "event_id", "ts", _hashed("user_id").alias("user_id_hash"), _hashed("session_id").alias("session_id_hash"), "document_id", "kind", "reason",
        F.when(F.col("kind") == QUARANTINE, F.col("payload")).alias("payload"),
        _field("fields_extracted").alias("fields_extracted"), _field("fields_attempted").alias("fields_attempted"), (_field("latency") * 1000).cast("long").alias("latency_ms"),
        *[_field(c).alias(c) for c in ("method", "prompt_version", "hallucination_detected", "from_state", "to_state", "turn_number", "total_turns")],
        half_up(_field("duration_seconds"), 1).alias("duration_seconds"),
        half_up(_field("mandatory_pct"), 2).alias("mandatory_completion_pct"), half_up(_field("optional_pct"), 2).alias("optional_completion_pct"),
    )
    if contexts is None:
        return out
    rest = [c for c in contexts.columns if c != "document_id"]
    clash = set(rest) & set(out.columns)
    if clash:
        raise ValueError(f"context columns named as event columns: {sorted(clash)}")
    single = contexts.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min(F.struct(*rest)).alias("_c")).select("document_id", "_c.*")
    return out.join(single, "document_id", "left").select(*out.columns, *rest)


def typed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch in one pass to folders by kind; a batch that is written again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return keep


def ingest(spark: SparkSession, source: str, path: str, state: str, contexts: DataFrame | None = None, most_bytes: str = "1g", every: str | None = "30 seconds") -> StreamingQuery:
    """Start the stream from Parquet files of RAW in ``source``: a batch each ``every``, or all there is at once if null, of about ``most_bytes`` at most."""
    raw = spark.readStream.schema(RAW).option("maxBytesPerTrigger", most_bytes).parquet(source)
    writer = typed_events(raw, contexts).writeStream.foreachBatch(typed_sink(path)).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingested(spark: SparkSession, path: str, context: str = "") -> DataFrame:
    """What typed_sink wrote; ``context``: the context's columns and types. A filter on kind reads those folders only."""
    return spark.read.schema(TYPED + (f", {context}" if context else "")).parquet(path)
