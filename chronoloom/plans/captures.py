"""Queries over captures, their frames, GPU work, call trees and stat values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import at_cap, contains_any, flag_names, role, scope_kind, speedup_ceiling
from chronoloom.operators.asof import backward
from chronoloom.operators.calltree import rollup, self_times
from chronoloom.operators.dist import busiest, distribution, histogram, milliseconds
from chronoloom.operators.graph import longest_chains
from chronoloom.operators.intervals import overlap_join, segments, union_length
from chronoloom.operators.records import latest_delivery
from chronoloom.session import cut_lineage, table

BUDGET = 1000.0 / 60.0
OUTLIERS = 40
# fixed values: fragments of timer names that tell of known patterns, and of work that is parallel already
PATTERNS = {
    "tick": ("tick",),
    "sync-load": ("staticloadobject", "loadobject", "loadpackage", "flushasyncloading", "synchronousloading", "loadmap", "getorload"),
    "object-churn": ("newobject", "spawnactor", "constructobject", "createdefaultsubobject", "duplicateobject"),
    "gc": ("collectgarbage", "garbagecollect", "gclock", "incrementalpurge"),
    "serialize": ("serialize",),
    "wait": ("waitfortasks", "waitfor"),
}
LEAST_SPECS = 2
PARALLEL_NAMES = ("parallel", "async", "task", "worker", "job", "thread", "concurrent", "dispatch", "lockfree")
VERDICTS = ("within", "thread", "wait", "gpu", "unknown")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["app", "platform", "build_version", "started_at", "start_cycle", "cycle_frequency", "frame_count", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "over_budget", "hitches"]
    return latest_delivery(table(spark, sf_dir, "captures"), ["capture_id"], "ingested_at", keep)


def once(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose deliveries of one key are copies, each key once."""
    return table(spark, sf_dir, name).drop("ingested_at").dropDuplicates([key])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their capture's frequency; ms from the clock, null for a frame that never closed."""
    clock = captures(spark, sf_dir).select("capture_id", "app", "build_version", "cycle_frequency")
    ms = milliseconds(F.col("begin_cycle"), F.col("end_cycle"), F.col("cycle_frequency"))
    return once(spark, sf_dir, "frames", "frame_id").join(clock, "capture_id").withColumn("ms", F.when(F.col("end_cycle") > F.col("begin_cycle"), ms))


def _micro(column: str) -> Column:
    return F.expr(f"({column} * 1000000L) div cycle_frequency")


def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, frame_id, tid, b, e: closed frames in microseconds."""
    return frames(spark, sf_dir).where("ms is not null").select("capture_id", "frame_id", "tid", "frame_type", _micro("begin_cycle").alias("b"), _micro("end_cycle").alias("e")).where("e > b")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def frame_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.sum(F.col("end_cycle") - F.col("begin_cycle")) * F.lit(1000.0) / (F.max("cycle_frequency") * F.count(F.lit(1)))
    return distribution(cut_lineage(frames(spark, sf_dir).select("capture_id", "tid", "frame_type", "begin_cycle", "end_cycle", "cycle_frequency", "ms")), ["capture_id", "tid", "frame_type"], "ms", BUDGET, mean)


def frame_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(histogram(frames(spark, sf_dir), ["frame_type"], "ms", BUDGET), "low", "high")


def busiest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busiest(frames(spark, sf_dir), ["capture_id"], ["tid", "frame_type"])


def over_budget_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the worst frames over budget: a top-k by (longest, begin, id)."""
    rows = frames(spark, sf_dir).where(F.col("ms") > BUDGET).select("frame_id", "capture_id", "tid", "begin_cycle", "ms")
    return rows.orderBy(F.col("ms").desc(), "begin_cycle", "frame_id").limit(OUTLIERS)


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per app and verdict; every verdict is there, with 0 where none fell to it."""
    rows = frames(spark, sf_dir).where("verdict is not null")
    buckets = rows.select("app").distinct().select("app", F.explode(F.array(*map(F.lit, VERDICTS))).alias("verdict"))
    counted = rows.groupBy("app", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counted, ["app", "verdict"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frame_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("capture_id").orderBy("begin_cycle", "frame_type", "tid", "end_cycle", "frame_id")
    return once(spark, sf_dir, "frames", "frame_id").select("capture_id", "frame_id", (F.row_number().over(order) - 1).alias("number"))


def warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose first frame took more than twice the median, of more than four frames."""
    rows = frames(spark, sf_dir).where("ms is not null")
    made = rows.groupBy("capture_id", "tid", "frame_type").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("ms", F.struct("begin_cycle", "frame_id")).alias("first_ms"), F.expr("percentile_disc(0.5) within group (order by ms)").alias("median")
    )
    return made.where("n > 4 and first_ms > 2 * median")


def display_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per capture and thread that lie at a multiple of a display period, where they are a quarter or more."""
    rows = frames(spark, sf_dir).where("ms is not null").groupBy("capture_id", "tid").agg(F.count(F.lit(1)).alias("n"), F.count_if(at_cap(F.col("ms") / 1000.0)).alias("at_cap"))
    return rows.where("at_cap >= 0.25 * n")


def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).where("ms is not null")
    made = rows.groupBy("capture_id", "tid", "frame_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round((F.max("end_cycle") - F.min("begin_cycle")) / F.max("cycle_frequency"), 6).alias("seconds"),
        F.expr("percentile_disc(0.5) within group (order by ms)").alias("median"),
        F.max("ms").alias("longest"),
    )
    return made.withColumn("label", F.concat_ws("/", "tid", "frame_type"))


def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the medians of an app's captures lie apart, as a share of the least."""
    made = captures(spark, sf_dir).where("p50_ms is not null").groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.min("p50_ms").alias("least"), F.max("p50_ms").alias("most"))
    return made.where("n > 1").withColumn("spread", F.round((F.col("most") - F.col("least")) / F.nullif("least", F.lit(0.0)), 6))


def _gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "gpu_spans", "span_id").where("begin_us > 0 and end_us > begin_us").select("capture_id", "queue", "kind", "span_id", F.col("begin_us").alias("b"), F.col("end_us").alias("e"))


def queue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per queue: spans, disjoint pieces and covered time of work and of waits; null where a kind never occurs."""
    rows = _gpu(spark, sf_dir)
    total = rows.groupBy("capture_id", "queue", "kind").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("e") - F.col("b")).alias("summed"))
    joined = total.join(union_length(rows, ["capture_id", "queue", "kind"]), ["capture_id", "queue", "kind"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return joined.groupBy("capture_id", "queue").agg(*[pick(k, c).alias(f"{k}_{c}") for k in ("work", "wait") for c in ("spans", "pieces", "covered", "summed")])


def queue_frame_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU work inside each frame of the game thread (type 0), summed over the queues; and spans that landed there."""
    return _gpu_in(spark, sf_dir, closed_frames(spark, sf_dir))


def _gpu_in(spark: SparkSession, sf_dir: str, closed: DataFrame) -> DataFrame:
    windows = closed.where("frame_type = 0").select("capture_id", "frame_id", _micro("begin_cycle").alias("b"), _micro("end_cycle").alias("e"))
    work = _gpu(spark, sf_dir).where("kind = 'work'").select("capture_id", "span_id", "b", "e")
    pairs = overlap_join(work, windows, ["capture_id"])
    return pairs.groupBy("capture_id", "frame_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("span_id").alias("spans"), F.sum(F.least("e", "r_e") - F.greatest("b", "r_b")).alias("gpu_us"))


def gpu_frames_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once_gpu_frames(spark, sf_dir)
    usable = (F.col("unbalanced") == 0) & (F.col("truncated") == 0)
    return rows.groupBy("capture_id", "tid").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("usable"), F.sum(F.when(usable, F.col("busy_us"))).alias("busy_us"), F.max(F.when(usable, F.col("depth"))).alias("deepest"))


def once_gpu_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "gpu_frames", "gpu_frame_id")


def queue_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of GPU frames per capture: calls, sum and the longest with its frame; the first of equals counts."""
    rows = once_gpu_frames(spark, sf_dir).select("capture_id", "gpu_frame_id", F.posexplode("passes").alias("at", "_p")).select("capture_id", "gpu_frame_id", "at", F.col("_p.spec").alias("spec"), F.col("_p.us").alias("us"))
    return rows.groupBy("capture_id", "spec").agg(F.count(F.lit(1)).alias("calls"), F.sum("us").alias("us"), F.max("us").alias("longest"), F.min_by("gpu_frame_id", F.struct(-F.col("us"), "gpu_frame_id", "at")).alias("longest_in"))


def clock_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of a capture's frame clock to its GPU clock from both extents, refused outside 1 +- 0.25."""
    windows = frame_windows(spark, sf_dir).groupBy("capture_id").agg((F.max("b") - F.min("b")).alias("cpu_us"))
    gpu = once_gpu_frames(spark, sf_dir).where("base_us > 0").groupBy("capture_id").agg((F.max("base_us") - F.min("base_us")).alias("gpu_us"))
    joined = windows.join(gpu, "capture_id").withColumn("scale", F.round(F.col("cpu_us") / F.nullif("gpu_us", F.lit(0)), 6))
    return joined.withColumn("accepted", F.coalesce(F.abs(F.col("scale") - 1) <= 0.25, F.lit(False)))


def partner_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each game-thread frame the overlapping frame of another thread that worked most; the first of equals."""
    return _partners(closed_frames(spark, sf_dir))


def closed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed frames with their clock, written once for all that reads them."""
    return cut_lineage(frames(spark, sf_dir).where("ms is not null").select("capture_id", "frame_id", "tid", "frame_type", "begin_cycle", "end_cycle", "covered_cycles", "wait_cycles", "cycle_frequency", "ms"))


def _partners(closed: DataFrame) -> DataFrame:
    rows = closed.select("capture_id", "frame_id", "tid", "frame_type", (F.col("covered_cycles") - F.col("wait_cycles")).alias("work"), F.col("begin_cycle").alias("b"), F.col("end_cycle").alias("e"))
    own = rows.where("frame_type = 0").select("capture_id", "frame_id", F.col("tid").alias("own_tid"), "b", "e")
    other = rows.select("capture_id", F.col("frame_id").alias("partner"), "tid", "work", "b", "e")
    pairs = overlap_join(own, other, ["capture_id"]).where("tid <> own_tid")
    best = F.min(F.struct(-F.coalesce("work", F.lit(-1)), "tid", "r_b", "r_e", "partner", "work")).alias("_best")
    return pairs.groupBy("capture_id", "frame_id").agg(F.count(F.lit(1)).alias("partners"), best).select("capture_id", "frame_id", "partners", "_best.partner", F.col("_best.work").alias("partner_work"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every game-thread frame with its verdict: within, or what it was bound by: own work, a partner's work, GPU work, else unexplained."""
    closed = closed_frames(spark, sf_dir)
    own = closed.where("frame_type = 0").select("capture_id", "frame_id", "begin_cycle", "ms", "cycle_frequency", (F.col("covered_cycles") - F.col("wait_cycles")).alias("work"))
    partners = _partners(closed).select("frame_id", "partner", "partner_work")
    gpu = _gpu_in(spark, sf_dir, closed).select("frame_id", "gpu_us")
    rows = own.join(partners, "frame_id", "left").join(gpu, "frame_id", "left")
    in_ms = lambda c: F.col(c) * F.lit(1000.0) / F.col("cycle_frequency")
    verdict = (
        F.when(F.col("ms") <= BUDGET, "within")
        .when(in_ms("work") >= BUDGET, "game")
        .when(in_ms("partner_work") >= BUDGET, "render")
        .when(F.col("gpu_us") / 1000.0 >= BUDGET, "gpu")
        .otherwise("unexplained")
    )
    return rows.withColumn("verdict", verdict)


def bottleneck_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of each capture fall to each verdict."""
    return _judged(spark, sf_dir).groupBy("capture_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def frame_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the longest frames with their verdict and partner: (longest, begin, id)."""
    rows = _judged(spark, sf_dir).orderBy(F.col("ms").desc(), "begin_cycle", "frame_id").limit(OUTLIERS)
    return rows.select("frame_id", "capture_id", "ms", "verdict", "partner", "gpu_us")


#: What the threads of the tables are called, as far as their numbers say.
THREAD_NAMES = {2: "GameThread", 17: "RHIThread", 98: "RenderThread 1"}


def chosen_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that reports are made of: the thread whose name reads as the game's with most frames, else the busiest."""
    known = F.create_map(*[F.lit(x) for pair in THREAD_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(known, F.col("tid")), F.concat(F.lit("Worker "), F.col("tid").cast("string")))
    counted = closed_frames(spark, sf_dir).groupBy("capture_id", "tid", "frame_type").agg(F.count(F.lit(1)).alias("n")).withColumn("role", role(name))
    order = Window.partitionBy("capture_id").orderBy((F.coalesce(F.col("role") == "game", F.lit(False))).desc(), F.col("n").desc(), "tid", "frame_type")
    return counted.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "nodes", "node_id").withColumn("inclusive", F.when(F.col("inclusive") >= 0, F.col("inclusive")))


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(_nodes(spark, sf_dir), ["capture_id"])


def frame_self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame the self time of its roots; null where no root was measured."""
    rows = self_times(_nodes(spark, sf_dir)).where("parent_node_id is null")
    return rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("roots"), F.sum("self").alias("self"))


def frames_by_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the frames with most self time: (self, id)."""
    return frame_self_time(spark, sf_dir).where("self is not null").orderBy(F.col("self").desc(), "frame_id").limit(OUTLIERS)


def top_self_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the nodes with most self time: (self, inclusive, smaller spec, smaller id)."""
    rows = self_times(_nodes(spark, sf_dir)).where("self is not null").select("node_id", "frame_id", "spec", "inclusive", "self")
    return rows.orderBy(F.col("self").desc(), F.col("inclusive").desc(), F.col("spec").asc_nulls_last(), "node_id").limit(OUTLIERS)


def _kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 longest frames of each thread."""
    longest = Window.partitionBy("capture_id", "tid").orderBy(F.col("ms").desc(), "begin_cycle", "frame_type", "frame_id")
    return frames(spark, sf_dir).where("ms > 0").withColumn("_k", F.row_number().over(longest)).where("_k <= 16")


def frame_work_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six timers that take most of each of the 16 longest frames of a thread, nested ones included."""
    kept = _kept_frames(spark, sf_dir).select("frame_id")
    cycles = _nodes(spark, sf_dir).where("spec is not null").join(kept, "frame_id", "left_semi").groupBy("frame_id", "spec").agg(F.sum("inclusive").alias("cycles")).where("cycles is not null")
    order = Window.partitionBy("frame_id").orderBy(F.col("cycles").desc(), "spec")
    return cycles.withColumn("place", F.row_number().over(order)).where("place <= 6")


def scope_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).withColumn("kind", scope_kind(F.col("name")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capture the first three timers that take a quarter or more of the span of its kept frames and that do not read as parallel.

    Kept are the 16 longest frames of each thread. Time is inclusive, so a nested timer counts beside the one that holds it.
    """
    kept = _kept_frames(spark, sf_dir).select("capture_id", "frame_id", (F.col("end_cycle") - F.col("begin_cycle")).alias("span"))
    total = kept.groupBy("capture_id").agg(F.sum("span").alias("total"))
    rows = _nodes(spark, sf_dir).where("inclusive is not null and name is not null").join(kept.select("frame_id"), "frame_id", "left_semi")
    share = rows.groupBy("capture_id", "name").agg(F.sum("inclusive").alias("cycles")).join(total, "capture_id").withColumn("share", F.round(F.col("cycles") / F.col("total"), 6))
    order = Window.partitionBy("capture_id").orderBy(F.col("cycles").desc(), "name")
    named = share.where((F.col("cycles") >= 0.25 * F.col("total")) & ~contains_any(F.col("name"), PARALLEL_NAMES))
    return named.withColumn("place", F.row_number().over(order)).where("place <= 3").select("capture_id", "name", "cycles", "share", "place")


def dimension_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per capture whose frame, parent or name is not there: counted, not guessed."""
    rows = once(spark, sf_dir, "nodes", "node_id")
    known = once(spark, sf_dir, "frames", "frame_id").select("frame_id", F.lit(True).alias("_framed"))
    joined = rows.join(known, "frame_id", "left")
    return joined.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_framed").isNull()).alias("unframed"), F.count_if(F.col("spec").isNull()).alias("specless"), F.count_if(F.col("name").isNull()).alias("nameless"))


def dedupe_last_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last definition of each uid of a capture, and how often it was defined."""
    rows = table(spark, sf_dir, "event_types").dropDuplicates(["capture_id", "seq"])
    made = rows.groupBy("capture_id", "uid").agg(F.count(F.lit(1)).alias("definitions"), F.max_by(F.struct("logger", "name", "flags", F.size("fields").alias("_n")), "seq").alias("_last"))
    return made.select("capture_id", "uid", "definitions", "_last.logger", "_last.name", flag_names(F.col("_last.flags")).alias("flag_names"), F.when(F.col("_last._n") >= 0, F.col("_last._n")).alias("fields"))


def event_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "event_types").dropDuplicates(["capture_id", "seq"])
    return rows.groupBy("logger", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("capture_id").alias("captures"), F.max("size").alias("largest"), F.count_if(F.col("fields").isNull()).alias("broken"))


def serial_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series of values: the extent of the 24-bit serials, what is carried and what is missing."""
    rows = once(spark, sf_dir, "csv_values", "value_id").groupBy("capture_id", "stat").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.countDistinct("seq").alias("carried"))
    span = (F.col("high") - F.col("low")).bitwiseAND(F.lit(0xFFFFFF)) + 1
    return rows.withColumn("missing", F.greatest(F.lit(0), span - F.col("carried")))


def csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stat values by frame of the game thread: timers add up, other values are combined in order of seq by their op.

    op 1 keeps the least, 2 the greatest, 3 adds; any other, null too, sets the value anew. A value belongs to the last frame that began at or before it; those before the first frame come with frame_id null.
    """
    values = once(spark, sf_dir, "csv_values", "value_id").where("value is not null").select("capture_id", "stat", "seq", "value_id", "cycle", "kind", "op", "value")
    windows = once(spark, sf_dir, "frames", "frame_id").where("frame_type = 0").select("capture_id", "frame_id", "begin_cycle")
    placed = backward(values, windows, ["capture_id"], "cycle", "begin_cycle", ["frame_id"])
    timer = F.col("kind") == "timer"
    combined = F.coalesce(F.col("op").isin(1, 2, 3), F.lit(False))
    key = F.struct("seq", "value_id")
    made = placed.groupBy("capture_id", "stat", "frame_id").agg(
        F.max("kind").alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(timer, F.col("value"))).alias("_sum"),
        F.max(F.when(~combined, F.struct(key.alias("key"), "value"))).alias("_set"),
        F.collect_list(F.when(combined & ~timer, F.struct(key.alias("key"), "op", "value"))).alias("_later"),
    )
    # what comes before the last value that was set no longer counts
    later = F.filter(F.array_sort("_later"), lambda x: F.col("_set").isNull() | (x["key"] > F.col("_set.key")))
    step = lambda acc, x: F.when(x["op"] == 1, F.least(acc, x["value"])).when(x["op"] == 2, F.greatest(acc, x["value"])).otherwise(F.coalesce(acc, F.lit(0.0)) + x["value"])
    value = F.when(F.col("kind") == "timer", F.col("_sum")).otherwise(F.aggregate(later, F.col("_set.value"), step))
    return made.select("capture_id", "stat", "frame_id", "n", F.round(value, 5).alias("value"))


def dominant_emitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread that emits most values of a capture; of equals the one seen first."""
    rows = once(spark, sf_dir, "csv_values", "value_id").groupBy("capture_id", "tid").agg(F.count(F.lit(1)).alias("n"), F.min("cycle").alias("first_seen"))
    order = Window.partitionBy("capture_id").orderBy(F.col("n").desc(), "first_seen", "tid")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def channel_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each capture can answer: whether it holds evidence for each kind of analysis."""
    held = None
    for name, key in (("frames", "frame_id"), ("gpu_frames", "gpu_frame_id"), ("gpu_spans", "span_id"), ("nodes", "node_id"), ("passes", "pass_id"), ("csv_values", "value_id")):
        rows = table(spark, sf_dir, name).groupBy("capture_id").agg(F.countDistinct(key).alias("n")).withColumn("channel", F.lit(name))
        held = rows if held is None else held.unionByName(rows)
    every = captures(spark, sf_dir).select("capture_id", F.explode(F.array(*map(F.lit, ("frames", "gpu_frames", "gpu_spans", "nodes", "passes", "csv_values")))).alias("channel"))
    joined = every.join(held, ["capture_id", "channel"], "left")
    return joined.select("capture_id", "channel", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "ready").otherwise("missing").alias("state"))


def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of lines of each order, each line following the one before it; quantity is the duration."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("duration"))
    tasks = lines.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), "duration")
    edges = lines.where("l_linenumber > 1").select((F.col("l_orderkey") * 16 + F.col("l_linenumber") - 1).alias("pred"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("succ"))
    best = longest_chains(tasks, edges.join(tasks.select(F.col("id").alias("pred")), "pred", "left_semi"))
    return best.groupBy((F.expr("id div 16")).alias("order_id")).agg(F.max("total").alias("total"), F.max_by("steps", F.struct("total", -F.col("id"))).alias("steps"))


def queue_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capture and thread: how long after the frame that holds it GPU work begins; submits without a frame counted."""
    windows = frame_windows(spark, sf_dir).select("capture_id", "tid", "frame_id", "b")
    submits = once_gpu_frames(spark, sf_dir).where("base_us > 0").select("capture_id", "tid", "gpu_frame_id", "base_us")
    placed = backward(submits, windows, ["capture_id", "tid"], "base_us", "b", ["frame_id"])
    lag = F.col("base_us") - F.col("b")
    made = placed.groupBy("capture_id", "tid").agg(F.count(F.lit(1)).alias("submits"), F.count_if(lag.isNull()).alias("unplaced"), F.sum(lag).alias("lag_us"), F.max(lag).alias("longest_us"))
    return made.withColumn("mean_us", F.round(F.col("lag_us") / F.nullif(F.col("submits") - F.col("unplaced"), F.lit(0)), 3))


def parallelism_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capture: cycles in which the game thread's frames run alone or beside others, the peak, the commonest peak of a
    frame (of equally common ones the smaller), and the gain that sharing the lone part out to as many threads, two at
    least, could bring at most. A stretch of time belongs to the game frame that began last before it."""
    rows = cut_lineage(frames(spark, sf_dir).where("ms is not null").select("capture_id", "frame_id", "frame_type", F.col("begin_cycle").alias("b"), F.col("end_cycle").alias("e")))
    own = (F.col("frame_type") == 0).cast("int")
    open_ = cut_lineage(segments(rows, ["capture_id"], {"own": own, "other": 1 - own}))
    length = F.col("until") - F.col("t")
    when = lambda c: F.sum(F.when(c, length).otherwise(0))
    made = open_.groupBy("capture_id").agg(when((F.col("own") > 0) & (F.col("other") == 0)).alias("solo"), when((F.col("own") > 0) & (F.col("other") > 0)).alias("shared"), F.max(F.col("own") + F.col("other")).alias("peak"))
    game = rows.where("frame_type = 0").select("capture_id", "frame_id", F.col("b").alias("f_b"))
    placed = backward(open_.where("own > 0").select("capture_id", "t", (F.col("own") + F.col("other")).alias("n")), game, ["capture_id"], "t", "f_b", ["frame_id"])
    peaks = placed.groupBy("capture_id", "frame_id").agg(F.max("n").alias("n")).groupBy("capture_id", "n").agg(F.count(F.lit(1)).alias("_c"))
    common = peaks.groupBy("capture_id").agg(F.max_by("n", F.struct("_c", -F.col("n"))).alias("threads_working"))
    share = F.col("solo") / F.nullif(F.col("solo") + F.col("shared"), F.lit(0))
    return made.join(common, "capture_id", "left").withColumn("ceiling", F.round(speedup_ceiling(share, F.greatest(F.lit(2), F.coalesce("threads_working", F.lit(2)))), 6))


def label_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that label a data set: rows and keys of each table."""
    made = None
    for name, key in (("captures", "capture_id"), ("frames", "frame_id"), ("gpu_frames", "gpu_frame_id"), ("gpu_spans", "span_id"), ("nodes", "node_id"), ("passes", "pass_id"), ("csv_values", "value_id")):
        row = table(spark, sf_dir, name).agg(F.lit(name).alias("source_table"), F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.countDistinct("capture_id").alias("captures"))
        made = row if made is None else made.unionByName(row)
    return made


_C = """
WITH c AS (SELECT capture_id, arg_max(app, ingested_at) AS app, arg_max(build_version, ingested_at) AS build_version, arg_max(started_at, ingested_at) AS started_at,
  arg_max(cycle_frequency, ingested_at) AS f, arg_max(frame_count, ingested_at) AS frame_count, arg_max(p50_ms, ingested_at) AS p50_ms, arg_max(p95_ms, ingested_at) AS p95_ms,
  arg_max(p99_ms, ingested_at) AS p99_ms, arg_max(over_budget, ingested_at) AS over_budget, arg_max(hitches, ingested_at) AS hitches FROM captures GROUP BY capture_id)
"""
_FR = (
    _C
    + """,
d AS (SELECT DISTINCT ON (frame_id) * FROM frames),
fr AS (SELECT d.*, c.app, c.f, CASE WHEN end_cycle > begin_cycle THEN (end_cycle - begin_cycle) * 1000.0::DOUBLE / f END AS ms FROM d JOIN c USING (capture_id)),
win AS (SELECT *, begin_cycle * 1000000 // f AS b, end_cycle * 1000000 // f AS e FROM fr WHERE ms IS NOT NULL AND end_cycle * 1000000 // f > begin_cycle * 1000000 // f)
"""
)
_GS = "gs AS (SELECT DISTINCT ON (span_id) capture_id, queue, kind, span_id, begin_us AS b, end_us AS e FROM gpu_spans WHERE begin_us > 0 AND end_us > begin_us)"
_GF = "gf AS (SELECT DISTINCT ON (gpu_frame_id) * FROM gpu_frames)"
_N = """nd AS (SELECT node_id, capture_id, frame_id, tid, spec, name, parent_node_id, calls, CASE WHEN inclusive >= 0 THEN inclusive END AS inclusive FROM (SELECT DISTINCT ON (node_id) * FROM nodes)),
tk AS (SELECT frame_id, parent_node_id AS node_id, sum(inclusive) AS taken FROM nd WHERE parent_node_id IS NOT NULL GROUP BY ALL),
sf AS (SELECT nd.*, greatest(0, inclusive - coalesce(taken, 0)) AS raw FROM nd LEFT JOIN tk USING (frame_id, node_id)),
st AS (SELECT * EXCLUDE raw, CASE WHEN inclusive IS NOT NULL THEN raw END AS self FROM sf)"""
_PARTNER = """,
pa AS (SELECT o.capture_id, o.frame_id, x.frame_id AS partner, x.covered_cycles - x.wait_cycles AS work, x.tid, x.begin_cycle AS xb, x.end_cycle AS xe
  FROM fr o JOIN fr x ON o.capture_id = x.capture_id AND o.tid <> x.tid AND o.begin_cycle < x.end_cycle AND x.begin_cycle < o.end_cycle
  WHERE o.frame_type = 0 AND o.ms IS NOT NULL AND x.ms IS NOT NULL),
best AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS partners, row_number() OVER (PARTITION BY frame_id ORDER BY coalesce(work, -1) DESC, tid, xb, xe, partner) AS k FROM pa)
"""
_PLACED = (
    ", "
    + _GS
    + """,
pl AS (SELECT w.capture_id, w.frame_id, count(*) AS pieces, count(DISTINCT span_id) AS spans, sum(least(gs.e, w.e) - greatest(gs.b, w.b)) AS gpu_us
  FROM gs JOIN win w ON gs.capture_id = w.capture_id AND gs.b < w.e AND w.b < gs.e WHERE gs.kind = 'work' AND w.frame_type = 0 GROUP BY ALL)
"""
)
_WORDS = lambda column, words: "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"
_CAP = " OR ".join(
    f"(round_even(ms / 1000.0 / (1.0::DOUBLE / {p}), 0) >= 1 AND abs(ms / 1000.0 - round_even(ms / 1000.0 / (1.0::DOUBLE / {p}), 0) * (1.0::DOUBLE / {p})) <= 0.05 * (1.0::DOUBLE / {p}))" for p in (60, 30, 120, 90)
)

QUERIES = {
    f.__name__: f
    for f in (
        frame_distribution, frame_histogram, busiest_series, over_budget_frames, verdict_counts, frame_numbering, warm_up, display_cap, series_stats, run_spread,
        queue_totals, queue_frame_placement, gpu_frames_usable, queue_passes, clock_scale, partner_frames, bottleneck_verdicts,
        call_tree, frame_self_time, frames_by_self, top_self_nodes, frame_verdicts, chosen_series, frame_work_topn, scope_kinds, candidates, dimension_misses,
        dedupe_last_definition, event_schema_counts, serial_gaps, csv_series, dominant_emitter, channel_verdicts, critical_path, queue_lag, parallelism_threads, label_facts,
    )
}

ORACLES = {
    "frame_distribution": _FR
    + f"""SELECT capture_id, tid, frame_type, count(*) AS n, CAST(sum(end_cycle - begin_cycle) AS BIGINT) * 1000.0::DOUBLE / (max(f) * count(*)) AS mean, min(ms) AS least, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
  quantile_disc(ms, 0.99) AS p99, max(ms) AS most, count(*) FILTER (WHERE ms > {BUDGET!r}) AS over, count(*) FILTER (WHERE ms > {2 * BUDGET!r}) AS hitches FROM fr WHERE ms IS NOT NULL GROUP BY ALL""",
    "frame_histogram": _FR
    + f""",
mx AS (SELECT frame_type, max(ms) AS most FROM fr WHERE ms IS NOT NULL GROUP BY ALL),
ed AS (SELECT frame_type, k, {BUDGET / 2!r}::DOUBLE * pow(2, k) AS edge FROM mx, range(0, 15) t(k) WHERE k = 0 OR {BUDGET / 2!r}::DOUBLE * pow(2, k) <= most),
bn AS (SELECT frame_type, 0 AS bin, 0.0::DOUBLE AS low, min(edge) AS high FROM ed GROUP BY ALL
  UNION ALL SELECT frame_type, k + 1, edge, lead(edge) OVER (PARTITION BY frame_type ORDER BY k) FROM ed)
SELECT bn.frame_type, bin, round(low, 6) AS low, round(high, 6) AS high, count(ms) AS n FROM bn LEFT JOIN fr ON fr.frame_type = bn.frame_type AND ms >= low AND (high IS NULL OR ms < high) GROUP BY ALL""",
    "busiest_series": _FR + "SELECT capture_id, tid, frame_type, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, tid, frame_type) AS k FROM (SELECT capture_id, tid, frame_type, count(*) AS n FROM fr GROUP BY ALL)) WHERE k = 1",
    "over_budget_frames": _FR + f"SELECT frame_id, capture_id, tid, begin_cycle, ms FROM fr WHERE ms > {BUDGET!r} ORDER BY ms DESC, begin_cycle, frame_id LIMIT {OUTLIERS}",
    "verdict_counts": _FR + f"SELECT a.app, v.verdict, count(frame_id) AS n FROM (SELECT DISTINCT app FROM fr WHERE verdict IS NOT NULL) a CROSS JOIN (SELECT unnest({list(VERDICTS)}) AS verdict) v LEFT JOIN fr ON fr.app = a.app AND fr.verdict = v.verdict GROUP BY ALL",
    "frame_numbering": _FR + "SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY begin_cycle, frame_type, tid, end_cycle NULLS FIRST, frame_id) - 1 AS number FROM d",
    "warm_up": _FR + "SELECT * FROM (SELECT capture_id, tid, frame_type, count(*) AS n, arg_min(ms, (begin_cycle, frame_id)) AS first_ms, quantile_disc(ms, 0.5) AS median FROM fr WHERE ms IS NOT NULL GROUP BY ALL) WHERE n > 4 AND first_ms > 2 * median",
    "display_cap": _FR + f"SELECT * FROM (SELECT capture_id, tid, count(*) AS n, count(*) FILTER (WHERE {_CAP}) AS at_cap FROM fr WHERE ms IS NOT NULL GROUP BY ALL) WHERE at_cap >= 0.25 * n",
    "series_stats": _FR + "SELECT capture_id, tid, frame_type, count(*) AS n, round((max(end_cycle) - min(begin_cycle)) / max(f), 6) AS seconds, quantile_disc(ms, 0.5) AS median, max(ms) AS longest, tid || '/' || frame_type AS label FROM fr WHERE ms IS NOT NULL GROUP BY capture_id, tid, frame_type",
    "run_spread": _C + "SELECT *, round((most - least) / nullif(least, 0), 6) AS spread FROM (SELECT app, count(*) AS n, min(p50_ms) AS least, max(p50_ms) AS most FROM c WHERE p50_ms IS NOT NULL GROUP BY ALL) WHERE n > 1",
    "queue_totals": "WITH "
    + _GS
    + """,
m AS (SELECT *, max(e) OVER (PARTITION BY capture_id, queue, kind ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM gs),
q AS (SELECT capture_id, queue, kind, count(*) AS spans, sum(e - b) AS summed, count(*) FILTER (WHERE far IS NULL OR b > far) AS pieces, sum(greatest(0, e - greatest(b, coalesce(far, b)))) AS covered FROM m GROUP BY ALL)
SELECT capture_id, queue, """
    + ", ".join(f"max({c}) FILTER (WHERE kind = '{k}') AS {k}_{c}" for k in ("work", "wait") for c in ("spans", "pieces", "covered", "summed"))
    + " FROM q GROUP BY ALL",
    "queue_frame_placement": _FR + _PLACED + "SELECT * FROM pl",
    "gpu_frames_usable": "WITH " + _GF + " SELECT capture_id, tid, count(*) AS n, count(*) FILTER (WHERE u) AS usable, sum(busy_us) FILTER (WHERE u) AS busy_us, max(depth) FILTER (WHERE u) AS deepest FROM (SELECT *, unbalanced = 0 AND truncated = 0 AS u FROM gf) GROUP BY ALL",
    "queue_passes": "WITH "
    + _GF
    + """, x AS (SELECT capture_id, gpu_frame_id, i AS at_, passes[i].spec AS spec, passes[i].us AS us FROM (SELECT *, unnest(range(1, len(passes) + 1)) AS i FROM gf))
SELECT capture_id, spec, count(*) AS calls, sum(us) AS us, max(us) AS longest, arg_min(gpu_frame_id, (-us, gpu_frame_id, at_)) AS longest_in FROM x GROUP BY ALL""",
    "clock_scale": _FR
    + ", "
    + _GF
    + """, a AS (SELECT capture_id, max(b) - min(b) AS cpu_us FROM win GROUP BY ALL), g AS (SELECT capture_id, max(base_us) - min(base_us) AS gpu_us FROM gf WHERE base_us > 0 GROUP BY ALL)
SELECT *, coalesce(abs(scale - 1) <= 0.25, false) AS accepted FROM (SELECT capture_id, cpu_us, gpu_us, round(cpu_us / nullif(gpu_us, 0), 6) AS scale FROM a JOIN g USING (capture_id))""",
    "partner_frames": _FR + _PARTNER + "SELECT capture_id, frame_id, partners, partner, work AS partner_work FROM best WHERE k = 1",
    "bottleneck_verdicts": _FR
    + _PARTNER
    + _PLACED
    + f"""SELECT fr.capture_id, CASE WHEN ms <= {BUDGET!r} THEN 'within' WHEN (covered_cycles - wait_cycles) * 1000.0::DOUBLE / f >= {BUDGET!r} THEN 'game'
  WHEN best.work * 1000.0::DOUBLE / f >= {BUDGET!r} THEN 'render' WHEN gpu_us / 1000.0::DOUBLE >= {BUDGET!r} THEN 'gpu' ELSE 'unexplained' END AS verdict, count(*) AS n
  FROM fr LEFT JOIN best ON best.frame_id = fr.frame_id AND best.k = 1 LEFT JOIN pl ON pl.frame_id = fr.frame_id WHERE frame_type = 0 AND ms IS NOT NULL GROUP BY ALL""",
    "frame_verdicts": _FR
    + _PARTNER
    + _PLACED
    + f"""SELECT fr.frame_id, fr.capture_id, ms, CASE WHEN ms <= {BUDGET!r} THEN 'within' WHEN (covered_cycles - wait_cycles) * 1000.0::DOUBLE / f >= {BUDGET!r} THEN 'game'
  WHEN best.work * 1000.0::DOUBLE / f >= {BUDGET!r} THEN 'render' WHEN gpu_us / 1000.0::DOUBLE >= {BUDGET!r} THEN 'gpu' ELSE 'unexplained' END AS verdict, best.partner, gpu_us
  FROM fr LEFT JOIN best ON best.frame_id = fr.frame_id AND best.k = 1 LEFT JOIN pl ON pl.frame_id = fr.frame_id WHERE frame_type = 0 AND ms IS NOT NULL ORDER BY ms DESC, fr.begin_cycle, fr.frame_id LIMIT {OUTLIERS}""",
    "chosen_series": _FR + """SELECT capture_id, tid, frame_type, n, role FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY coalesce(role, '') = 'game' DESC, n DESC, tid, frame_type) AS k
  FROM (SELECT capture_id, tid, frame_type, count(*) AS n, CASE tid WHEN 2 THEN 'game' WHEN 17 THEN 'rhi' WHEN 98 THEN 'render' END AS role FROM fr WHERE ms IS NOT NULL GROUP BY ALL)) WHERE k = 1""",
    "frames_by_self": "WITH " + _N + f" SELECT frame_id, count(*) AS roots, sum(self) AS self FROM st WHERE parent_node_id IS NULL GROUP BY frame_id HAVING sum(self) IS NOT NULL ORDER BY self DESC, frame_id LIMIT {OUTLIERS}",
    "call_tree": "WITH RECURSIVE "
    + _N
    + """, r AS (SELECT st.*, 1 AS level, CAST(coalesce(spec, -1) AS VARCHAR) AS path FROM st WHERE parent_node_id IS NULL
  UNION ALL SELECT st.*, level + 1, path || '>' || coalesce(st.spec, -1) FROM st JOIN r ON st.frame_id = r.frame_id AND st.parent_node_id = r.node_id)
SELECT capture_id, path, level, count(*) AS nodes, sum(calls) AS calls, sum(inclusive) AS inclusive, sum(self) AS self FROM r GROUP BY ALL""",
    "frame_self_time": "WITH " + _N + " SELECT frame_id, count(*) AS roots, sum(self) AS self FROM st WHERE parent_node_id IS NULL GROUP BY ALL",
    "top_self_nodes": "WITH " + _N + f" SELECT node_id, frame_id, spec, inclusive, self FROM st WHERE self IS NOT NULL ORDER BY self DESC, inclusive DESC, spec NULLS LAST, node_id LIMIT {OUTLIERS}",
    "frame_work_topn": _FR
    + ", "
    + _N
    + """, kp AS (SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY capture_id, tid ORDER BY ms DESC, begin_cycle, frame_type, frame_id) AS k FROM fr WHERE ms > 0) WHERE k <= 16),
cy AS (SELECT frame_id, spec, sum(inclusive) AS cycles FROM nd WHERE spec IS NOT NULL AND frame_id IN (SELECT frame_id FROM kp) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cycles DESC, spec) AS place FROM cy WHERE cycles IS NOT NULL) WHERE place <= 6""",
    "scope_kinds": "WITH " + _N + " SELECT CASE WHEN contains(lower(name), 'wait') THEN 'wait' WHEN regexp_matches(name, '(Lock|Locks|Locked|Unlock|Mutex|Critical|Semaphore)([^a-z]|$)') THEN 'lock' ELSE 'work' END AS kind, count(*) AS n, sum(calls) AS calls FROM nd GROUP BY ALL",
    "candidates": _FR
    + ", "
    + _N
    + f""", kp AS (SELECT capture_id, frame_id, end_cycle - begin_cycle AS span FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, tid ORDER BY ms DESC, begin_cycle, frame_type, frame_id) AS k FROM fr WHERE ms > 0) WHERE k <= 16),
tt AS (SELECT capture_id, sum(span) AS total FROM kp GROUP BY ALL),
sh AS (SELECT capture_id, name, sum(inclusive) AS cycles FROM nd WHERE inclusive IS NOT NULL AND name IS NOT NULL AND frame_id IN (SELECT frame_id FROM kp) GROUP BY ALL)
SELECT * FROM (SELECT capture_id, name, cycles, round(cycles / total, 6) AS share, row_number() OVER (PARTITION BY capture_id ORDER BY cycles DESC, name) AS place FROM sh JOIN tt USING (capture_id) WHERE cycles >= 0.25 * total AND NOT {_WORDS("name", PARALLEL_NAMES)}) WHERE place <= 3""",
    "dimension_misses": "WITH n AS (SELECT DISTINCT ON (node_id) * FROM nodes), f AS (SELECT DISTINCT frame_id FROM frames) SELECT capture_id, count(*) AS n, count(*) FILTER (WHERE f.frame_id IS NULL) AS unframed, count(*) FILTER (WHERE spec IS NULL) AS specless, count(*) FILTER (WHERE name IS NULL) AS nameless FROM n LEFT JOIN f USING (frame_id) GROUP BY ALL",
    "dedupe_last_definition": "WITH e AS (SELECT DISTINCT ON (capture_id, seq) * FROM event_types) SELECT capture_id, uid, definitions, logger, name, flag_names, fields FROM (SELECT capture_id, uid, logger, name, flag_names, len(fields) AS fields, count(*) OVER (PARTITION BY capture_id, uid) AS definitions, row_number() OVER (PARTITION BY capture_id, uid ORDER BY seq DESC) AS k FROM e) WHERE k = 1",
    "event_schema_counts": "SELECT logger, name, count(*) AS n, count(DISTINCT capture_id) AS captures, max(size) AS largest, count(*) FILTER (WHERE fields IS NULL) AS broken FROM (SELECT DISTINCT ON (capture_id, seq) * FROM event_types) GROUP BY ALL",
    "serial_gaps": "SELECT *, greatest(0, ((high - low) & 16777215) + 1 - carried) AS missing FROM (SELECT capture_id, stat, min(seq) AS low, max(seq) AS high, count(DISTINCT seq) AS carried FROM csv_values GROUP BY ALL)",
    "csv_series": """WITH v AS (SELECT DISTINCT ON (value_id) * FROM csv_values), f AS (SELECT DISTINCT ON (frame_id) capture_id, frame_id, begin_cycle FROM frames WHERE frame_type = 0),
b AS (SELECT capture_id, begin_cycle, max(frame_id) AS frame_id FROM f GROUP BY ALL),
p AS (SELECT v.*, b.frame_id FROM v ASOF LEFT JOIN b ON v.capture_id = b.capture_id AND v.cycle >= b.begin_cycle WHERE value IS NOT NULL)
SELECT capture_id, stat, frame_id, count(*) AS n, round(CASE WHEN max(kind) = 'timer' THEN sum(value) ELSE list_reduce(list({'op': coalesce(op, 0), 'value': value} ORDER BY seq, value_id), lambda a, x: {'op': 0, 'value': CASE x.op WHEN 1 THEN least(a.value, x.value) WHEN 2 THEN greatest(a.value, x.value) WHEN 3 THEN a.value + x.value ELSE x.value END}).value END, 5) AS value FROM p GROUP BY ALL""",
    "dominant_emitter": "SELECT capture_id, tid, n, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, first_seen, tid) AS k FROM (SELECT capture_id, tid, count(DISTINCT value_id) AS n, min(cycle) AS first_seen FROM csv_values GROUP BY ALL)) WHERE k = 1",
    "channel_verdicts": "WITH h AS ("
    + " UNION ALL ".join(f"SELECT capture_id, '{t}' AS channel, count(DISTINCT {k}) AS n FROM {t} GROUP BY capture_id" for t, k in (("frames", "frame_id"), ("gpu_frames", "gpu_frame_id"), ("gpu_spans", "span_id"), ("nodes", "node_id"), ("passes", "pass_id"), ("csv_values", "value_id")))
    + "), c AS (SELECT DISTINCT capture_id FROM captures), l AS (SELECT unnest(['frames', 'gpu_frames', 'gpu_spans', 'nodes', 'passes', 'csv_values']) AS channel) SELECT capture_id, channel, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'ready' ELSE 'missing' END AS state FROM c CROSS JOIN l LEFT JOIN h USING (capture_id, channel)",
}
ORACLES |= {
    "queue_lag": _FR
    + ", "
    + _GF
    + """, l AS (SELECT capture_id, tid, b, max(frame_id) AS frame_id FROM win GROUP BY ALL),
p AS (SELECT g.capture_id, g.tid, g.base_us - l.b AS lag FROM (SELECT * FROM gf WHERE base_us > 0) g ASOF LEFT JOIN l ON g.capture_id = l.capture_id AND g.tid = l.tid AND g.base_us >= l.b)
SELECT *, round(lag_us / nullif(submits - unplaced, 0), 3) AS mean_us FROM (SELECT capture_id, tid, count(*) AS submits, count(*) FILTER (WHERE lag IS NULL) AS unplaced, sum(lag) AS lag_us, max(lag) AS longest_us FROM p GROUP BY ALL)""",
    "parallelism_threads": _FR
    + """, k AS (SELECT capture_id, t, sum(o) AS o, sum(x) AS x FROM (SELECT capture_id, begin_cycle AS t, CAST(frame_type = 0 AS INT) AS o, CAST(frame_type <> 0 AS INT) AS x FROM fr WHERE ms IS NOT NULL
  UNION ALL SELECT capture_id, end_cycle, -CAST(frame_type = 0 AS INT), -CAST(frame_type <> 0 AS INT) FROM fr WHERE ms IS NOT NULL) GROUP BY ALL),
q AS (SELECT capture_id, t, lead(t) OVER w AS u, sum(o) OVER w AS o, sum(x) OVER w AS x FROM k WINDOW w AS (PARTITION BY capture_id ORDER BY t)),
g AS (SELECT capture_id, sum(CASE WHEN o > 0 AND x = 0 THEN u - t ELSE 0 END) AS solo, sum(CASE WHEN o > 0 AND x > 0 THEN u - t ELSE 0 END) AS shared, max(o + x) AS peak FROM q WHERE u IS NOT NULL GROUP BY ALL),
gf AS (SELECT capture_id, begin_cycle, max(frame_id) AS frame_id FROM fr WHERE ms IS NOT NULL AND frame_type = 0 GROUP BY ALL),
pf AS (SELECT capture_id, frame_id, max(n) AS n FROM (SELECT q.capture_id, gf.frame_id, o + x AS n FROM (SELECT * FROM q WHERE u IS NOT NULL AND o > 0) q ASOF LEFT JOIN gf ON q.capture_id = gf.capture_id AND q.t >= gf.begin_cycle) GROUP BY ALL),
cm AS (SELECT capture_id, arg_max(n, (c, -n)) AS threads_working FROM (SELECT capture_id, n, count(*) AS c FROM pf GROUP BY ALL) GROUP BY ALL)
SELECT g.*, threads_working, round(CASE WHEN solo <= 0 THEN 1.0 ELSE 1.0::DOUBLE / ((1 - solo / nullif(solo + shared, 0)) + solo / nullif(solo + shared, 0) / greatest(2, coalesce(threads_working, 2))) END, 6) AS ceiling FROM g LEFT JOIN cm USING (capture_id)""",
    "label_facts": " UNION ALL ".join(
        f"SELECT '{t}' AS source_table, count(*) AS n, count(DISTINCT {k}) AS keys, count(DISTINCT capture_id) AS captures FROM {t}"
        for t, k in (("captures", "capture_id"), ("frames", "frame_id"), ("gpu_frames", "gpu_frame_id"), ("gpu_spans", "span_id"), ("nodes", "node_id"), ("passes", "pass_id"), ("csv_values", "value_id"))
    ),
}
ORACLES |= {
    "critical_path": "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM l), s AS (SELECT l_orderkey, g, sum(q) AS total, count(*) AS steps, max(l_linenumber) AS last FROM r GROUP BY ALL) SELECT l_orderkey AS order_id, max(total) AS total, arg_max(steps, (total, -last)) AS steps FROM s GROUP BY l_orderkey",
}
