"""Vector confidence learned from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up
from formlode.shared import written

START, BOOST, DECAY, TOP, BOTTOM = 0.75, 1.05, 0.95, 0.99, 0.50
#: Most events of one vector in a row.
SEGMENT = 4096


def next_confidence(conf: Column, positive: Column) -> Column:
    """One learning step: up by a factor to at most TOP or down to at least BOTTOM, to 6 digits."""
    return half_up(F.when(positive, F.least(conf * BOOST, F.lit(TOP))).otherwise(F.greatest(conf * DECAY, F.lit(BOTTOM))), 6)


def _segments(events: DataFrame, *kept: str) -> DataFrame:
    """(vector_id, seg, e): each vector's events in order, cut into rows of at most SEGMENT; events without a vector are left out.

    The events are range-sorted by vector, time and id, so a hot vector spans many tasks; a row's place in its task numbers the
    segments. The rows are stored, since places may differ between two evaluations of a range sort.
    """
    order = ["vector_id", "ts", "event_id", "positive"]
    sorted_ = events.filter("vector_id IS NOT NULL").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    listed = F.array_sort(F.collect_list(F.struct("_at", *kept, "positive"))).alias("e")
    placed = sorted_.withColumn("_at", F.monotonically_increasing_id())
    return written(placed.groupBy("vector_id", F.floor(F.col("_at") / SEGMENT).alias("seg")).agg(listed), "segments")


def _folded(begin: Column) -> Column:
    """(conf, total) after a segment from ``begin``; total is the sum of the confidences after each event in millionths."""
    state = F.struct(begin.alias("conf"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, e: Column) -> Column:
        conf = next_confidence(s["conf"], e["positive"])
        return F.struct(conf.alias("conf"), (s["total"] + F.round(conf * 1_000_000).cast("long")).alias("total"))

    return F.aggregate("e", state, step)


def _begun(segments: DataFrame, start: float) -> DataFrame:
    """segments with ``begin``, the confidence before each.

    A step never falls as the confidence rises, so a segment folded from both ends of the range ends alike from any start once the
    two meet. Segments are so folded in parallel; those that leave the ends apart pass on their value one segment a round
    (with alternating signs the ends meet after about 550 events, so at this size that is a rare, exact remainder).
    """
    order = Window.partitionBy("vector_id").orderBy("seg")
    first = F.row_number().over(order) == 1
    ends = segments.withColumn("_first", first).withColumns({
        "low": _folded(F.when(F.col("_first"), F.lit(start)).otherwise(F.lit(min(BOTTOM, start))))["conf"],
        "high": _folded(F.when(F.col("_first"), F.lit(start)).otherwise(F.lit(max(TOP, start))))["conf"],
    }).select("vector_id", "seg", "low", "high")
    before = F.when(F.lag("low").over(order) == F.lag("high").over(order), F.lag("low").over(order))
    known = ends.select("vector_id", "seg", F.when(first, F.lit(start)).otherwise(before).alias("begin"), F.lead("seg").over(order).alias("next"))
    known = written(known, "begins")
    while not known.filter("begin IS NULL").isEmpty():
        waiting = known.filter("begin IS NULL").select("vector_id", F.col("seg").alias("next"))
        ready = known.filter("begin IS NOT NULL").join(waiting, ["vector_id", "next"], "left_semi")
        passed = segments.join(ready, ["vector_id", "seg"]).select("vector_id", F.col("next").alias("seg"), _folded(F.col("begin"))["conf"].alias("passed"))
        known = known.join(passed, ["vector_id", "seg"], "left").select("vector_id", "seg", F.coalesce("begin", "passed").alias("begin"), "next")
        known = written(known, "begins")
    return segments.join(known.drop("next"), ["vector_id", "seg"])


def confidence_fold(events: DataFrame, start: float = START) -> DataFrame:
    """(vector_id, confidence, steps, total) after the ordered events (vector_id, ts, event_id, positive).

    Clamping makes the order matter, so events are taken by time, then id; total is the sum of the start and all confidences after
    it. A vector's events are folded in segments (see _begun), never gathered into one row.
    """
    folded = _begun(_segments(events), start).select("vector_id", "seg", F.size("e").alias("n"), _folded(F.col("begin")).alias("s"))
    total = (F.sum("s.total") + round(start * 1_000_000)) / F.lit(1_000_000.0)
    return folded.groupBy("vector_id").agg(F.max_by("s.conf", "seg").alias("confidence"), F.sum("n").cast("int").alias("steps"), total.alias("total"))


def confidence_history(events: DataFrame, start: float = START) -> DataFrame:
    """(vector_id, ts, event_id, confidence): the confidence after each event, one row an event."""
    walked = lambda: F.aggregate("e", F.array("begin"), lambda h, e: F.concat(h, F.array(next_confidence(F.element_at(h, -1), e["positive"]))))
    rows = _begun(_segments(events, "ts", "event_id"), start).select("vector_id", F.explode(F.arrays_zip("e", F.slice(walked(), 2, SEGMENT).alias("h"))).alias("x"))
    return rows.select("vector_id", "x.e.ts", "x.e.event_id", F.col("x.h").alias("confidence"))


def vector_stability(events: DataFrame, start: float = START) -> DataFrame:
    """Positive and negative counts, stability (1 without events) and mean of the start and all later confidences of each vector."""
    counts = events.groupBy("vector_id").agg(F.count_if("positive").alias("positive_count"), F.count_if(~F.col("positive")).alias("negative_count"))
    total = F.col("positive_count") + F.col("negative_count")
    folded = confidence_fold(events, start).select("vector_id", half_up(F.col("total") / (F.col("steps") + 1), 4).alias("avg_confidence"))
    return counts.withColumn("stability", F.when(total == 0, 1.0).otherwise(half_up(F.col("positive_count") / total, 4))).join(folded, "vector_id")


def next_vector_ids(existing: DataFrame, new: DataFrame, order: str, bucket: Column, width: int = 6) -> DataFrame:
    """new with vector_id = prefix and the next numbers, zero-padded, in the order of a column.

    bucket: a coarse value that never falls as ``order`` rises. Rows are numbered within buckets and bucket counts are summed, so
    that no window spans the table.
    """
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("vector_id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("_top"))
    local = new.withColumn("_b", bucket).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = local.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).select("_b", before.alias("_before"))
    numbered = local.join(starts, "_b").crossJoin(F.broadcast(top))  # one row
    number = F.lpad((F.col("_top") + F.col("_before") + F.col("_n")).cast("string"), width, "0")
    return numbered.withColumn("vector_id", F.concat(F.lit("vec_"), number)).drop("_b", "_n", "_before", "_top")
