"""Queries over GPU queues: the spans of gpu_spans and the frames of gpu_frames as the events a GPU channel would send.

A span of work opens and closes work and a crumb (spec is its id modulo 7, none for every fiftieth), a wait is said whole
and names the next queue, for every twentieth none. The submit's own time lies up to 900 us before the work, or after it.
Frames of the GPU are boundaries and counts of queue 0. Events of a capture are in order of their times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import gpu as op
from chronoloom.operators.asof import contained
from chronoloom.operators.hot import Cut
from chronoloom.plans.captures import frame_windows, once, once_gpu_frames
from chronoloom.session import cut_lineage

SPECS = 7
LIMIT = 40


def gpu_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, tid, seq, kind, queue, spec, top, bop, cpu, other, number, draws, primitives."""
    null = lambda kind: F.lit(None).cast(kind)
    work, wait, b, e, i = F.col("kind") == "work", F.col("kind") == "wait", F.col("begin_us"), F.col("end_us"), F.col("span_id")
    spec = F.when(i % 50 != 0, i % SPECS)
    cpu = F.when(i % 11 == 0, F.lit(0)).otherwise(b - i % 900 + 100)

    def said(kind, at, d, when, spec=null("long"), top=null("long"), bop=null("long"), cpu=null("long"), other=null("long")):  # noqa: ANN001, ANN202
        return F.when(when & at.isNotNull(), F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.lit(d).alias("d"), spec.cast("long").alias("spec"), top.alias("top"), bop.alias("bop"), cpu.cast("long").alias("cpu"), other.cast("long").alias("other")))

    kinds = F.array(
        said("BeginWork", b, 2, work, top=b, cpu=cpu), said("EndWork", e, 0, work, bop=e),
        said("BeginCrumb", b, 3, work, spec=spec, top=b), said("EndCrumb", e, 1, work, bop=e),
        said("Wait", b, 4, wait & e.isNotNull(), top=b, bop=e), said("Signal", b, 5, work & (i % 10 == 0)),
        said("WaitFence", b, 6, wait, other=F.when(i % 20 != 0, (F.col("queue") + 1) % 3)),
    )
    spans = once(spark, sf_dir, "gpu_spans", "span_id").select("capture_id", "queue", "span_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_e"))
    spans = spans.select("capture_id", F.col("queue").cast("long").alias("queue"), F.col("span_id").alias("id"), "_e.*", null("long").alias("number"), null("long").alias("draws"), null("long").alias("primitives"))
    frames = once_gpu_frames(spark, sf_dir).where("base_us is not null")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(d).alias("d"), n.cast("long").alias("number"), w.cast("long").alias("draws"), p.cast("long").alias("primitives")) for k, d, n, w, p in (("Boundary", 7, F.col("number"), null("long"), null("long")), ("Stats", 8, null("long"), F.col("events"), F.col("depth")))])).alias("_e")
    marks = frames.select("capture_id", F.lit(0).cast("long").alias("queue"), F.col("gpu_frame_id").alias("id"), F.col("base_us").alias("at"), both).select("capture_id", "queue", "id", "at", "_e.*")
    every = spans.unionByName(marks, allowMissingColumns=True).withColumn("tid", F.pmod("queue", F.lit(2)))
    order = Cut(every, ["capture_id"], ["at", "d", "id"], "at").running("seq", "sum", F.lit(1)).done()
    return order.select("capture_id", "tid", "seq", "kind", "queue", "spec", "top", "bop", "cpu", "other", "number", "draws", "primitives")


def gpu_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queue of a capture with what its events sum up to, in order of the queues."""
    rows = op.queue_rows(cut_lineage(gpu_events(spark, sf_dir)), ["capture_id"])
    return rows.withColumn("lag_mean_ms", F.floor(F.round(F.col("lag_mean_ms") * 1e6, 3)) / 1e6).orderBy("capture_id", "queue")


def gpu_walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk over each capture's queues cannot use, counted."""
    return op.walk_counts(cut_lineage(gpu_events(spark, sf_dir)), ["capture_id"])


def gpu_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passes of each capture with most time, and how many lesser ones there are."""
    kept, dropped = op.passes(cut_lineage(gpu_events(spark, sf_dir)), ["capture_id"], 3)
    return kept.join(dropped, "capture_id")


def queue_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences that queues signalled, and those of other queues that they waited for."""
    return op.fences(gpu_events(spark, sf_dir), []).orderBy("fence", "queue", "other")


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = cut_lineage(op.spans(cut_lineage(gpu_events(spark, sf_dir)), ["capture_id"]))
    windows = cut_lineage(frame_windows(spark, sf_dir).where("frame_type = 0").select("capture_id", "frame_id", "b", "e"))
    return op.placement(spans, windows, ["capture_id"])


def gpu_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the queues of a capture fit on its frames: spans of work, those that lie in a frame, and the verdict."""
    return _placed(spark, sf_dir)[1]


def gpu_frame_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the frames with most GPU work, where the queues fit on them: (most work, frame)."""
    frames, _ = _placed(spark, sf_dir)
    return frames.orderBy(F.coalesce("work_us", F.lit(0)).desc(), "frame_id").limit(LIMIT)


def gpu_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the frames of the GPU's own clock fall on each capture's game frames: the scale between the clocks, how many
    usable frames lie in a window, and whether both speak for it (scale within a quarter of 1, half of the frames in one)."""
    windows = cut_lineage(frame_windows(spark, sf_dir).where("frame_type = 0").select("capture_id", F.col("frame_id"), F.col("b").cast("double").alias("b"), F.col("e").cast("double").alias("e")))
    usable = cut_lineage(once_gpu_frames(spark, sf_dir).where("unbalanced = 0 and truncated = 0 and base_us is not null").select("capture_id", "gpu_frame_id", "base_us"))
    cpu = windows.groupBy("capture_id").agg(F.min("b").alias("first"), (F.max_by("e", F.struct("b", "e")) - F.min("b")).alias("span"))
    gpu = usable.groupBy("capture_id").agg(F.min("base_us").alias("first_us"), (F.max("base_us") - F.min("base_us")).alias("gpu_span"), F.count(F.lit(1)).alias("frames"))
    fit = gpu.join(cpu, "capture_id").where("gpu_span > 0 and span > 0").withColumn("scale", F.col("span") / F.col("gpu_span"))
    points = usable.join(fit, "capture_id").select("capture_id", "gpu_frame_id", (F.col("first") + (F.col("base_us") - F.col("first_us")) * F.col("scale")).alias("at"))
    found = contained(points, windows, ["capture_id"], "at", "b", "e", ["frame_id"]).groupBy("capture_id").agg(F.count("frame_id").alias("contained"))
    made = fit.join(found, "capture_id").select("capture_id", F.round("scale", 6).alias("scale"), "frames", "contained", ((F.abs(F.col("scale") - 1) <= op.SCALE_ROOM) & (F.col("contained") >= op.LEAST_PLACED * F.col("frames"))).alias("accepted"))
    return made


def gpu_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work of each capture and queue seen as one frame of the older channel: busy time, depth and its three largest passes."""
    events = gpu_events(spark, sf_dir).where("kind in ('BeginCrumb', 'EndCrumb')")
    records = events.select("capture_id", "queue", F.col("seq").alias("ord"), F.coalesce("top", "bop").alias("t"), F.coalesce("spec", F.lit(0)).alias("spec"), F.when(F.col("kind") == "BeginCrumb", 1).otherwise(-1).alias("d")).where("t <> 0")
    made = op.decoded_frames(cut_lineage(records), ["capture_id", "queue"], 3)
    return made.select("capture_id", "queue", "busy_us", "events", "depth", "unbalanced", F.array_join(F.transform("passes", lambda p: F.concat_ws(":", p["spec"], p["us"])), " ").alias("passes"))


QUERIES = {f.__name__: f for f in (gpu_queues, gpu_walk_counts, gpu_passes, queue_fences, gpu_placement, gpu_frame_report, gpu_align, gpu_decoded)}

_EVENTS = """
WITH s AS (SELECT DISTINCT ON (span_id) capture_id, CAST(queue AS BIGINT) AS queue, span_id AS id, kind AS k, begin_us AS b, end_us AS e FROM gpu_spans),
h AS (SELECT DISTINCT ON (gpu_frame_id) * FROM gpu_frames), n AS (SELECT NULL::BIGINT AS z),
u AS (SELECT capture_id, queue, id, 'BeginWork' AS kind, b AS at_, 2 AS d0, z AS spec, b AS top, z AS bop, CASE WHEN id % 11 = 0 THEN 0 ELSE b - id % 900 + 100 END AS cpu, z AS other, z AS number, z AS draws, z AS prims FROM s, n WHERE k = 'work'
  UNION ALL SELECT capture_id, queue, id, 'EndWork', e, 0, z, z, e, z, z, z, z, z FROM s, n WHERE k = 'work'
  UNION ALL SELECT capture_id, queue, id, 'BeginCrumb', b, 3, CASE WHEN id % 50 <> 0 THEN id % 7 END, b, z, z, z, z, z, z FROM s, n WHERE k = 'work'
  UNION ALL SELECT capture_id, queue, id, 'EndCrumb', e, 1, z, z, e, z, z, z, z, z FROM s, n WHERE k = 'work'
  UNION ALL SELECT capture_id, queue, id, 'Wait', b, 4, z, b, e, z, z, z, z, z FROM s, n WHERE k = 'wait' AND e IS NOT NULL
  UNION ALL SELECT capture_id, queue, id, 'Signal', b, 5, z, z, z, z, z, z, z, z FROM s, n WHERE k = 'work' AND id % 10 = 0
  UNION ALL SELECT capture_id, queue, id, 'WaitFence', b, 6, z, z, z, z, CASE WHEN id % 20 <> 0 THEN (queue + 1) % 3 END, z, z, z FROM s, n WHERE k = 'wait'
  UNION ALL SELECT capture_id, 0, gpu_frame_id, 'Boundary', base_us, 7, z, z, z, z, z, number, z, z FROM h, n
  UNION ALL SELECT capture_id, 0, gpu_frame_id, 'Stats', base_us, 8, z, z, z, z, z, z, events, depth FROM h, n),
ev AS (SELECT *, queue % 2 AS tid, row_number() OVER (PARTITION BY capture_id ORDER BY at_, d0, id) AS seq FROM u WHERE at_ IS NOT NULL),
st AS (SELECT capture_id, tid, queue, seq, spec, right(kind, 4) AS stack, CASE WHEN kind LIKE 'Begin%' THEN 1 ELSE -1 END AS d, coalesce(top, bop) AS t FROM ev WHERE kind IN ('BeginWork', 'EndWork', 'BeginCrumb', 'EndCrumb') AND coalesce(top, bop) <> 0),
x1 AS (SELECT *, sum(d) OVER (PARTITION BY capture_id, queue, stack ORDER BY seq) AS su FROM st),
x2 AS (SELECT *, least(0, min(su) OVER (PARTITION BY capture_id, queue, stack ORDER BY seq)) AS lo FROM x1),
x3 AS (SELECT *, d = -1 AND su < coalesce(lag(lo) OVER (PARTITION BY capture_id, queue, stack ORDER BY seq), 0) AS bad, su - lo AS dep FROM x2),
x4 AS (SELECT *, CASE WHEN d = 1 THEN dep ELSE dep + 1 END AS level FROM x3 WHERE NOT bad),
x5 AS (SELECT *, lead(d) OVER w AS nd, lead(t) OVER w AS nt FROM x4 WINDOW w AS (PARTITION BY capture_id, queue, stack, level ORDER BY seq)),
br AS (SELECT *, CASE WHEN nd = -1 THEN nt END AS et FROM x5 WHERE d = 1),
sp AS (SELECT capture_id, queue, 'work' AS kind, t AS b, et AS e, seq FROM br WHERE stack = 'Work' AND et >= t UNION ALL SELECT capture_id, queue, 'wait', top, bop, seq FROM ev WHERE kind = 'Wait' AND NOT (top = 0 AND bop = 0) AND bop >= top)
"""
_WINDOWS = """,
c AS (SELECT capture_id, arg_max(cycle_frequency, ingested_at) AS f FROM captures GROUP BY capture_id),
fd AS (SELECT DISTINCT ON (frame_id) * FROM frames),
win AS (SELECT capture_id, frame_id, begin_cycle * 1000000 // f AS b, end_cycle * 1000000 // f AS e FROM fd JOIN c USING (capture_id) WHERE frame_type = 0 AND end_cycle > begin_cycle AND end_cycle * 1000000 // f > begin_cycle * 1000000 // f)
"""
_PLACED = """,
pr AS (SELECT sp.capture_id, win.frame_id, sp.kind, sp.queue, sp.seq, least(sp.e, win.e) - greatest(sp.b, win.b) AS inside FROM sp JOIN win ON sp.capture_id = win.capture_id AND sp.b < win.e AND win.b < sp.e WHERE sp.e > sp.b),
la AS (SELECT capture_id, count(DISTINCT (queue, seq)) AS placed FROM pr WHERE kind = 'work' GROUP BY ALL),
ve AS (SELECT capture_id, count(*) AS spans, coalesce(max(placed), 0) AS placed, coalesce(max(placed), 0) > 0 AND coalesce(max(placed), 0) >= 0.5 * count(*) AS accepted FROM sp LEFT JOIN la USING (capture_id) WHERE kind = 'work' GROUP BY ALL)
"""
ORACLES = {
    "gpu_queues": _EVENTS
    + """,
lg AS (SELECT *, CASE WHEN kind = 'BeginWork' AND top <> 0 AND cpu > 0 THEN top - cpu END AS lag FROM ev),
a AS (SELECT capture_id, queue, count(*) FILTER (WHERE kind = 'BeginWork' AND top <> 0) AS submits, coalesce(sum(lag) FILTER (WHERE lag >= 0), 0) AS lag_total_us, count(*) FILTER (WHERE lag < 0) AS lag_negative, coalesce(max(lag) FILTER (WHERE lag >= 0), 0) AS lag_max_us,
  count(*) FILTER (WHERE kind = 'Boundary' AND number IS NOT NULL) AS boundaries, coalesce(sum(draws), 0) AS draws, coalesce(sum(prims), 0) AS primitives, coalesce(arg_max(number, seq) FILTER (WHERE kind = 'Boundary' AND number IS NOT NULL), 0) AS last_frame FROM lg GROUP BY ALL),
m AS (SELECT *, max(e) OVER (PARTITION BY capture_id, queue, kind ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM sp WHERE e > b),
k AS (SELECT capture_id, queue, sum(greatest(0, e - greatest(b, coalesce(far, b)))) FILTER (WHERE kind = 'work') AS busy_us, sum(greatest(0, e - greatest(b, coalesce(far, b)))) FILTER (WHERE kind = 'wait') AS wait_us FROM m GROUP BY ALL),
q AS (SELECT capture_id, queue, count(*) FILTER (WHERE kind = 'work') AS work_spans, count(*) FILTER (WHERE kind = 'wait') AS wait_spans FROM sp GROUP BY ALL)
SELECT a.*, coalesce(busy_us, 0) AS busy_us, coalesce(wait_us, 0) AS wait_us, coalesce(work_spans, 0) AS work_spans, coalesce(wait_spans, 0) AS wait_spans,
  floor(round(CASE WHEN submits - lag_negative > 0 THEN lag_total_us / (submits - lag_negative) / 1000.0::DOUBLE END * 1e6, 3)) / 1e6 AS lag_mean_ms FROM a LEFT JOIN k USING (capture_id, queue) LEFT JOIN q USING (capture_id, queue)""",
    "gpu_walk_counts": _EVENTS
    + """,
fr AS (SELECT *, max(t) OVER (PARTITION BY capture_id, queue ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM st),
a AS (SELECT capture_id, count(*) FILTER (WHERE kind IN ('BeginWork', 'BeginCrumb') AND top = 0 OR kind IN ('EndWork', 'EndCrumb') AND bop = 0 OR kind = 'Wait' AND top = 0 AND bop = 0) AS zero_times, count(*) FILTER (WHERE kind = 'Wait' AND bop < top AND NOT (top = 0 AND bop = 0)) AS wb,
  count(*) FILTER (WHERE kind = 'BeginCrumb' AND top <> 0 AND spec IS NULL) AS specless FROM ev GROUP BY ALL),
o AS (SELECT capture_id, count(*) FILTER (WHERE d = 1 AND t < far) AS out_of_order FROM fr GROUP BY ALL),
p AS (SELECT capture_id, count(*) FILTER (WHERE bad) AS ub FROM x3 GROUP BY ALL), q AS (SELECT capture_id, count(*) FILTER (WHERE et IS NULL) AS uo, count(*) FILTER (WHERE et < t) AS bk FROM br GROUP BY ALL)
SELECT a.capture_id, zero_times, coalesce(ub, 0) + coalesce(uo, 0) AS unpaired, wb + coalesce(bk, 0) AS negative, coalesce(out_of_order, 0) AS out_of_order, specless FROM a LEFT JOIN o USING (capture_id) LEFT JOIN p USING (capture_id) LEFT JOIN q USING (capture_id)""",
    "gpu_passes": _EVENTS
    + """,
y AS (SELECT capture_id, coalesce(spec, 0) AS spec, count(*) AS calls, sum(et - t) AS inclusive_us, max(et - t) AS max_us, arg_min(t, (t - et, tid, seq)) AS max_begin_us FROM br WHERE stack = 'rumb' AND et >= t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY inclusive_us DESC, spec) AS place, count(*) OVER (PARTITION BY capture_id) AS c FROM y) SELECT * EXCLUDE c, greatest(0, c - 3) AS dropped FROM r WHERE place <= 3""",
    "queue_fences": _EVENTS + "SELECT CASE kind WHEN 'Signal' THEN 'signal' ELSE 'wait' END AS fence, queue, coalesce(other, 0) AS other, count(*) AS n FROM ev WHERE kind = 'Signal' OR kind = 'WaitFence' AND other IS NOT NULL GROUP BY ALL",
    "gpu_placement": _EVENTS + _WINDOWS + _PLACED + "SELECT * FROM ve",
    "gpu_frame_report": _EVENTS
    + _WINDOWS
    + _PLACED
    + f"SELECT capture_id, frame_id, sum(inside) FILTER (WHERE kind = 'work') AS work_us, sum(inside) FILTER (WHERE kind = 'wait') AS wait_us FROM pr WHERE capture_id IN (SELECT capture_id FROM ve WHERE accepted) GROUP BY capture_id, frame_id ORDER BY coalesce(work_us, 0) DESC, frame_id LIMIT {LIMIT}",
    "gpu_decoded": _EVENTS
    + """,
y AS (SELECT capture_id, queue, coalesce(spec, 0) AS spec, sum(et - t) AS us FROM br WHERE stack = 'rumb' AND et IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, queue ORDER BY us DESC, spec) AS k FROM y), z AS (SELECT capture_id, queue, string_agg(spec || ':' || us, ' ' ORDER BY k) AS passes FROM r WHERE k <= 3 GROUP BY ALL),
f AS (SELECT capture_id, queue, coalesce(sum(et - t) FILTER (WHERE level = 1), 0) AS busy, count(*) AS n, max(level) AS depth, count(*) FILTER (WHERE et IS NULL) AS open FROM br WHERE stack = 'rumb' GROUP BY ALL),
b AS (SELECT capture_id, queue, count(*) FILTER (WHERE bad) AS bad FROM x3 WHERE stack = 'rumb' GROUP BY ALL)
SELECT capture_id, queue, CASE WHEN odd THEN 0 ELSE busy END AS busy_us, CASE WHEN odd THEN 0 ELSE n END AS events, CASE WHEN odd THEN 0 ELSE depth END AS depth, bad + open + CAST(odd AS INT) AS unbalanced, CASE WHEN odd THEN '' ELSE coalesce(passes, '') END AS passes
  FROM (SELECT b.capture_id, b.queue, bad, coalesce(open, 0) AS open, coalesce(busy, 0) AS busy, coalesce(n, 0) AS n, coalesce(depth, 0) AS depth, coalesce(busy, 0) > 3600000000 AS odd, passes FROM b LEFT JOIN f USING (capture_id, queue) LEFT JOIN z USING (capture_id, queue))""",
    "gpu_align": "WITH g AS (SELECT DISTINCT ON (gpu_frame_id) * FROM gpu_frames), us AS (SELECT capture_id, gpu_frame_id, base_us FROM g WHERE unbalanced = 0 AND truncated = 0 AND base_us IS NOT NULL)"
    + _WINDOWS
    + """,
cp AS (SELECT capture_id, min(b) AS first, arg_max(e, (b, e)) - min(b) AS span FROM win GROUP BY ALL), gs AS (SELECT capture_id, min(base_us) AS first_us, max(base_us) - min(base_us) AS gpu_span, count(*) AS frames FROM us GROUP BY ALL),
ft AS (SELECT *, span::DOUBLE / gpu_span AS scale FROM gs JOIN cp USING (capture_id) WHERE gpu_span > 0 AND span > 0),
pt AS (SELECT us.capture_id, gpu_frame_id, first::DOUBLE + (base_us - first_us) * scale AS at_ FROM us JOIN ft USING (capture_id)),
we AS (SELECT capture_id, e::DOUBLE AS e, arg_min(b, frame_id)::DOUBLE AS b FROM win GROUP BY ALL),
fo AS (SELECT pt.capture_id, count(*) FILTER (WHERE we.b <= at_) AS contained FROM pt ASOF LEFT JOIN we ON pt.capture_id = we.capture_id AND pt.at_ <= we.e GROUP BY ALL)
SELECT capture_id, round(scale, 6) AS scale, frames, contained, abs(scale - 1) <= 0.25 AND contained >= 0.5 * frames AS accepted FROM ft JOIN fo USING (capture_id)""",
}
