"""Queues of a GPU from their events: two stacks per queue, spans, lags, passes, fences and placement on frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut
from chronoloom.operators.intervals import overlap_join, union_length
from chronoloom.operators.pairing import pairing_counts, stack_pairs

PASSES_KEPT = 24
LEAST_PLACED = 0.5
SCALE_ROOM = 0.25


def _stamped(events: DataFrame) -> DataFrame:
    """Begins and ends of both stacks with stack, d and t; a time of 0 could not be told and is left out."""
    begin, end = F.col("kind").startswith("Begin"), F.col("kind").startswith("End")
    rows = events.where("kind in ('BeginWork', 'EndWork', 'BeginCrumb', 'EndCrumb')")
    rows = rows.withColumn("stack", F.substring("kind", -4, 4)).withColumn("d", F.when(begin, 1).otherwise(-1)).withColumn("t", F.when(end, F.col("bop")).otherwise(F.col("top")))
    return rows.where("t is not null and t <> 0 and queue is not null")


def brackets(events: DataFrame, by: Sequence[str], hot: int = HOT) -> DataFrame:
    """by..., tid, queue, stack, level, seq, spec, t, end_time: every begin of work and of crumbs with the end that closed it."""
    return stack_pairs(_stamped(events).select(*by, "tid", "queue", "stack", "seq", "spec", "t", "d"), [*by, "tid", "queue", "stack"], time="t", hot=hot)


def spans(events: DataFrame, by: Sequence[str], hot: int = HOT) -> DataFrame:
    """by..., queue, kind, b, e: work from its brackets and waits as they were said, none with a negative length."""
    work = brackets(events.where("kind in ('BeginWork', 'EndWork')"), by, hot).where("end_time >= t").select(*by, "queue", F.lit("work").alias("kind"), F.col("t").alias("b"), F.col("end_time").alias("e"))
    waits = events.where("kind = 'Wait' and queue is not null and not (top = 0 and bop = 0) and bop >= top").select(*by, "queue", F.lit("wait").alias("kind"), F.col("top").alias("b"), F.col("bop").alias("e"))
    return work.unionByName(waits)


def queue_rows(events: DataFrame, by: Sequence[str], hot: int = HOT) -> DataFrame:
    """by..., queue and what its events sum up to: spans and covered time of work and waits, submits and how long after
    its submit work began, boundaries with the last frame number, draws and primitives.

    A submit whose own time is 0 or missing has no lag; one that is later than its work counts as negative. The last frame
    is the last one of a thread, and the greatest over the threads.
    """
    keys = [*by, "queue"]
    lag = F.when((F.col("kind") == "BeginWork") & (F.col("top") != 0) & (F.col("cpu") > 0), F.col("top") - F.col("cpu"))
    is_ = lambda k: F.col("kind") == k
    rows = events.where("queue is not null")
    said = rows.groupBy(*keys).agg(
        F.count_if(is_("BeginWork") & (F.col("top") != 0)).alias("submits"),
        F.coalesce(F.sum(F.when(lag >= 0, lag)), F.lit(0)).alias("lag_total_us"),
        F.count_if(lag < 0).alias("lag_negative"),
        F.coalesce(F.max(F.when(lag >= 0, lag)), F.lit(0)).alias("lag_max_us"),
        F.count_if(is_("Boundary") & F.col("number").isNotNull()).alias("boundaries"),
        F.coalesce(F.sum("draws"), F.lit(0)).alias("draws"),
        F.coalesce(F.sum("primitives"), F.lit(0)).alias("primitives"),
    )
    marks = rows.where("kind = 'Boundary' and number is not null").groupBy(*keys, "tid").agg(F.max_by("number", "seq").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("last_frame"))
    made = spans(events, by, hot)
    counted = made.groupBy(*keys).agg(F.count_if(is_("work")).alias("work_spans"), F.count_if(is_("wait")).alias("wait_spans"))
    covered = union_length(made, [*keys, "kind"]).groupBy(*keys).agg(*[F.max(F.when(is_(k), F.col("covered"))).alias(n) for k, n in (("work", "busy_us"), ("wait", "wait_us"))])
    joined = said.join(marks, keys, "left").join(counted, keys, "left").join(covered, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("last_frame", "work_spans", "wait_spans", "busy_us", "wait_us")}
    mean = F.col("lag_total_us") / F.nullif(F.greatest(F.lit(0), F.col("submits") - F.col("lag_negative")), F.lit(0)) / 1000.0
    return joined.withColumns(zero).withColumn("lag_mean_ms", mean)


def walk_counts(events: DataFrame, by: Sequence[str], hot: int = HOT) -> DataFrame:
    """by..., zero_times, unpaired, negative, out_of_order, specless: what a walk over the queues cannot use, counted.

    A begin is out of order where its time lies before the greatest one of its thread and queue so far.
    """
    zero = F.when(F.col("kind").isin("BeginWork", "BeginCrumb"), F.col("top") == 0).when(F.col("kind").isin("EndWork", "EndCrumb"), F.col("bop") == 0).when(F.col("kind") == "Wait", (F.col("top") == 0) & (F.col("bop") == 0))
    wait_back = (F.col("kind") == "Wait") & (F.col("bop") < F.col("top")) & ~((F.col("top") == 0) & (F.col("bop") == 0))
    said = events.where("queue is not null").groupBy(*by).agg(F.count_if(zero).alias("zero_times"), F.count_if(wait_back).alias("_waits"), F.count_if((F.col("kind") == "BeginCrumb") & (F.col("top") != 0) & F.col("spec").isNull()).alias("specless"))
    stamped = _stamped(events)
    keys = [*by, "tid", "queue"]
    late = Cut(stamped, keys, ["seq"], "seq", hot).running("_far", "max", F.col("t"), inclusive=False).done()
    late = late.groupBy(*by).agg(F.count_if((F.col("d") == 1) & (F.col("t") < F.col("_far"))).alias("out_of_order"))
    counts = pairing_counts(stamped, [*keys, "stack"], hot=hot).groupBy(*by).agg((F.sum("unpaired_ends") + F.sum("unpaired_begins")).alias("unpaired"))
    back = brackets(events, by, hot).groupBy(*by).agg(F.count_if(F.col("end_time") < F.col("t")).alias("_back"))
    joined = said
    for part in (late, counts, back):
        joined = joined.join(part, list(by), "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("out_of_order", "unpaired", "_back")}
    return joined.withColumns(zeros).select(*by, "zero_times", "unpaired", (F.col("_waits") + F.col("_back")).alias("negative"), "out_of_order", "specless")


def passes(events: DataFrame, by: Sequence[str], kept: int = PASSES_KEPT, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """by..., spec, calls, inclusive_us, max_us, max_begin_us of the passes with most time; and by..., dropped.

    A crumb without a spec is spec 0. Of equally long calls the first by (tid, seq of its begin) counts.
    """
    rows = brackets(events.where("kind in ('BeginCrumb', 'EndCrumb')"), by, hot).where("end_time >= t").withColumn("spec", F.coalesce("spec", F.lit(0)))
    took = F.col("end_time") - F.col("t")
    made = rows.groupBy(*by, "spec").agg(F.count(F.lit(1)).alias("calls"), F.sum(took).alias("inclusive_us"), F.max(took).alias("max_us"), F.min_by("t", F.struct(-took, "tid", "seq")).alias("max_begin_us"))
    order = Window.partitionBy(*by).orderBy(F.col("inclusive_us").desc(), "spec")
    placed = made.withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= kept), placed.groupBy(*by).agg(F.count_if(F.col("place") > kept).alias("dropped"))


def fences(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., fence, queue, other, n: fences a queue signalled (other 0) and those of another queue it waited for."""
    rows = events.where("queue is not null and (kind = 'Signal' or kind = 'WaitFence' and other is not null)")
    return rows.groupBy(*by, F.when(F.col("kind") == "Signal", "signal").otherwise("wait").alias("fence"), "queue", F.when(F.col("kind") == "Signal", F.lit(0)).otherwise(F.col("other")).alias("other")).agg(F.count(F.lit(1)).alias("n"))


def placement(made: DataFrame, windows: DataFrame, by: Sequence[str], least: float = LEAST_PLACED) -> tuple[DataFrame, DataFrame]:
    """by..., frame_id, work_us, wait_us where the timeline fits; and by..., spans, placed, accepted.

    made are spans (by..., kind, b, e), windows disjoint frames (by..., frame_id, b, e) in one unit. A timeline that does not
    meet the windows at all, or of whose work spans fewer than least lie in one, is refused: then no frame gets a number.
    """
    rows = made.where("e > b").withColumn("_id", F.monotonically_increasing_id())
    pairs = overlap_join(rows, windows.select(*by, "frame_id", "b", "e"), list(by))
    inside = F.least("e", "r_e") - F.greatest("b", "r_b")
    frames = pairs.groupBy(*by, "frame_id").agg(F.sum(F.when(F.col("kind") == "work", inside)).alias("work_us"), F.sum(F.when(F.col("kind") == "wait", inside)).alias("wait_us"))
    landed = pairs.where("kind = 'work'").groupBy(*by).agg(F.countDistinct("_id").alias("placed"))
    every = made.where("kind = 'work'").groupBy(*by).agg(F.count(F.lit(1)).alias("spans"))
    verdict = every.join(landed, list(by), "left").withColumn("placed", F.coalesce("placed", F.lit(0))).withColumn("accepted", (F.col("placed") > 0) & (F.col("placed") >= F.lit(least) * F.col("spans")))
    return frames.join(verdict.where("accepted").select(*by), list(by), "left_semi"), verdict




def decoded_frames(records: DataFrame, by: Sequence[str], kept: int = 6, longest_us: int = 3_600_000_000) -> DataFrame:
    """by..., busy_us, events, depth, unbalanced, passes of the frames of the older channel.

    records has by..., ord, t (microseconds), spec and d (1 begin, -1 end). Busy is the time with any pass open, a pass the
    sum of its calls, the kept largest by (time, smaller spec). A frame busy for more than an hour is not believed: nothing
    but one more unbalanced record is left of it.
    """
    pairs = stack_pairs(records.select(*by, "ord", "t", "spec", "d"), by, "ord", "d", "t")
    took = F.col("end_time") - F.col("t")
    frames = pairs.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("level") == 1, took)), F.lit(0)).alias("busy_us"), F.count(F.lit(1)).alias("events"), F.max("level").alias("depth"))
    bad = pairing_counts(records, by, "ord").select(*by, (F.col("unpaired_ends") + F.col("unpaired_begins")).alias("unbalanced"))
    each = pairs.where("end_time is not null").groupBy(*by, "spec").agg(F.sum(took).alias("us"))
    each = each.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("us")).alias("o"), "spec", "us"))), 1, kept).alias("_p"))
    joined = bad.join(frames, list(by), "left").join(each, list(by), "left")
    odd = F.col("busy_us") > longest_us
    number = lambda c: F.when(odd, 0).otherwise(F.coalesce(c, F.lit(0)))
    none = F.array().cast("array<struct<spec: bigint, us: bigint>>")
    made = F.transform("_p", lambda x: F.struct(x["spec"].cast("long").alias("spec"), x["us"].alias("us")))
    return joined.select(*by, number("busy_us").alias("busy_us"), number("events").alias("events"), number("depth").alias("depth"), (F.col("unbalanced") + F.when(odd, 1).otherwise(0)).alias("unbalanced"), F.when(odd, none).otherwise(F.coalesce(made, none)).alias("passes"))
