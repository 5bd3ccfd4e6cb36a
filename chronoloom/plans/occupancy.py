"""Queries over who works inside whose frames: events as scopes of sixteen threads, days of threads 0 and 1 as frames.

A sign-up is a scope that waits, a click one inside a lock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import occupancy as op
from chronoloom.plans.traces import _DAYS, _SPANS, DAY, days, spans
from chronoloom.session import cut_lineage

FRAME_THREADS = (0, 1)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.filter(F.array(F.lit("busy"), F.when(F.col("spec") == "signup", "wait"), F.when(F.col("spec") == "click", "lock")), lambda x: x.isNotNull())
    return cut_lineage(spans(spark, sf_dir).select("tid", F.explode(kinds).alias("kind"), "b", "e"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(days(spark, sf_dir).where(F.col("tid").isin(*FRAME_THREADS)).select((F.col("day") * 16 + F.col("tid")).alias("frame_id"), "tid", "b", "e"))


def thread_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thread's busy, waiting and locked time, the busiest first."""
    return op.thread_totals(_typed(spark, sf_dir), []).orderBy(F.col("busy").desc(), "tid")


def occupancy_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads that work inside the frames of thread 0, and those that only work elsewhere: (most busy, tid)."""
    typed = _typed(spark, sf_dir)
    threads, _ = op.occupancy(typed, _frames(spark, sf_dir).where("tid = 0"), [])
    return op.beside(threads, op.thread_totals(typed, []), []).orderBy(F.col("busy").desc(), "tid")


def occupancy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame with its solo time, others' work, all covered time, most threads at once and contention."""
    return op.occupancy(_typed(spark, sf_dir), _frames(spark, sf_dir), [])[1]


def frame_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covered and the waiting time of every day of every thread, by the scopes that end in it."""
    scopes = spans(spark, sf_dir).select("tid", (F.col("spec") == "signup").alias("waits"), "b", "e")
    frames = days(spark, sf_dir).select("tid", F.col("day").alias("frame_id"), F.col("b").alias("f_b"), F.col("e").alias("f_e"))
    return op.coverage(scopes, frames, ["tid"])


def occupancy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each thread together: sums, contended frames, the commonest peak and the solo share."""
    frames = cut_lineage(occupancy_frames(spark, sf_dir)).withColumn("tid", F.pmod("frame_id", F.lit(16)))
    order = Window.partitionBy("tid").orderBy(F.col("n").desc(), "peak")
    peaks = frames.groupBy("tid", "peak").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.row_number().over(order)).where("_k = 1").select("tid", F.col("peak").alias("threads_working"))
    sums = frames.groupBy("tid").agg(F.count(F.lit(1)).alias("frames"), *[F.sum(c).alias(c) for c in ("solo", "others_work", "all", "contended")], F.count_if(F.col("contended") > 0).alias("contended_frames"))
    return sums.join(peaks, "tid")


QUERIES = {f.__name__: f for f in (thread_spans, occupancy_threads, occupancy_frames, frame_coverage, occupancy_totals)}

_MERGE = """
{n}_m AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {of} WHERE b < e),
{n}_i AS (SELECT *, sum(CASE WHEN b <= far THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM {n}_m),
{n} AS (SELECT {by}, min(b) AS b, max(e) AS e FROM {n}_i GROUP BY {by}, island)
"""
_TYPED = (
    _SPANS
    + """, ty AS (SELECT tid, 'busy' AS kind, b, e FROM s UNION ALL SELECT tid, CASE spec WHEN 'signup' THEN 'wait' ELSE 'lock' END, b, e FROM s WHERE spec IN ('signup', 'click')),"""
    + _MERGE.format(n="mt", by="tid, kind", of="ty")
    + """, tot AS (SELECT tid, count(*) FILTER (WHERE kind = 'busy') AS spans, coalesce(sum(e - b) FILTER (WHERE kind = 'busy'), 0) AS busy, coalesce(sum(e - b) FILTER (WHERE kind = 'wait'), 0) AS wait, coalesce(sum(e - b) FILTER (WHERE kind = 'lock'), 0) AS lock FROM mt GROUP BY tid)"""
)
_IN_FRAMES = f""",
fm AS (SELECT DISTINCT (b - b % {DAY}) // {DAY} * 16 + tid AS frame_id, tid AS f_tid, b - b % {DAY} AS fb, b - b % {DAY} + {DAY} AS fe FROM s WHERE tid IN (0, 1)),
pc AS (SELECT frame_id, f_tid, tid, kind, greatest(b, fb) AS b, least(e, fe) AS e FROM mt JOIN fm ON b < fe AND fb < e),
th AS (SELECT frame_id, f_tid, tid, coalesce(sum(e - b) FILTER (WHERE kind = 'busy'), 0) AS busy, coalesce(sum(e - b) FILTER (WHERE kind = 'wait'), 0) AS wait, coalesce(sum(e - b) FILTER (WHERE kind = 'lock'), 0) AS lock FROM pc GROUP BY ALL),
ck AS (SELECT frame_id, f_tid, tid, t, sum(o) AS o, sum(x) AS x FROM (SELECT frame_id, f_tid, tid, b AS t, CAST(kind = 'busy' AS INT) AS o, CAST(kind = 'wait' AS INT) AS x FROM pc UNION ALL SELECT frame_id, f_tid, tid, e, -CAST(kind = 'busy' AS INT), -CAST(kind = 'wait' AS INT) FROM pc) GROUP BY ALL),
cq AS (SELECT *, lead(t) OVER w AS u, sum(o) OVER w AS oo, sum(x) OVER w AS xx FROM ck WINDOW w AS (PARTITION BY frame_id, tid ORDER BY t)),
wk AS (SELECT frame_id, f_tid, tid, t AS b, u AS e FROM cq WHERE oo > 0 AND xx = 0 AND u IS NOT NULL),
ok AS (SELECT frame_id, t, sum(o) AS o, sum(x) AS x FROM (SELECT frame_id, b AS t, CAST(tid = f_tid AS INT) AS o, CAST(tid <> f_tid AS INT) AS x FROM wk UNION ALL SELECT frame_id, e, -CAST(tid = f_tid AS INT), -CAST(tid <> f_tid AS INT) FROM wk) GROUP BY ALL),
oq AS (SELECT frame_id, t, lead(t) OVER w AS u, sum(o) OVER w AS o, sum(x) OVER w AS x FROM ok WINDOW w AS (PARTITION BY frame_id ORDER BY t)),
oa AS (SELECT frame_id, sum(CASE WHEN o > 0 AND x = 0 THEN u - t ELSE 0 END) AS solo, sum(CASE WHEN x > 0 THEN u - t ELSE 0 END) AS others_work, max(o + x) AS peak FROM oq WHERE u IS NOT NULL GROUP BY ALL),
bs AS (SELECT frame_id, b, e FROM pc WHERE kind = 'busy'),{_MERGE.format(n="bm", by="frame_id", of="bs")},
lk AS (SELECT frame_id, t, sum(n) AS n FROM (SELECT frame_id, b AS t, 1 AS n FROM pc WHERE kind = 'lock' UNION ALL SELECT frame_id, e, -1 FROM pc WHERE kind = 'lock') GROUP BY ALL),
lq AS (SELECT frame_id, t, lead(t) OVER w AS u, sum(n) OVER w AS n FROM lk WINDOW w AS (PARTITION BY frame_id ORDER BY t)),
oc AS (SELECT f.frame_id, coalesce(solo, 0) AS solo, coalesce(others_work, 0) AS others_work, coalesce(peak, 0) AS peak, coalesce(c, 0) AS "all", coalesce(k, 0) AS contended FROM (SELECT DISTINCT frame_id FROM pc) f LEFT JOIN oa USING (frame_id)
  LEFT JOIN (SELECT frame_id, sum(e - b) AS c FROM bm GROUP BY ALL) USING (frame_id) LEFT JOIN (SELECT frame_id, sum(CASE WHEN n > 1 THEN u - t ELSE 0 END) AS k FROM lq WHERE u IS NOT NULL GROUP BY ALL) USING (frame_id))
"""
ORACLES = {
    "thread_spans": _TYPED + " SELECT * FROM tot",
    "occupancy_threads": _TYPED
    + _IN_FRAMES
    + """, ins AS (SELECT tid, count(*) AS frames, sum(busy) AS busy, sum(wait) AS wait, sum(lock) AS lock FROM th WHERE f_tid = 0 GROUP BY tid)
SELECT *, false AS elsewhere FROM ins UNION ALL SELECT tid, 0, 0, 0, 0, true FROM tot WHERE busy > 0 AND tid NOT IN (SELECT tid FROM ins)""",
    "occupancy_frames": _TYPED + _IN_FRAMES + " SELECT * FROM oc",
    "frame_coverage": _SPANS
    + _DAYS
    + """, a AS (SELECT s.tid, s.id, s.spec, s.b, s.e, min(fe) AS fe FROM s JOIN days ON s.tid = days.tid AND fe >= s.e GROUP BY ALL),
p AS (SELECT a.tid, day AS frame_id, spec = 'signup' AS waits, greatest(a.b, fb) AS b, a.e AS e FROM a JOIN days ON a.tid = days.tid AND a.fe = days.fe WHERE fb <= a.e), pw AS (SELECT * FROM p WHERE waits),"""
    + _MERGE.format(n="cm", by="tid, frame_id", of="p")
    + ","
    + _MERGE.format(n="wm", by="tid, frame_id", of="pw")
    + "SELECT tid, frame_id, covered, coalesce(waiting, 0) AS waiting FROM (SELECT tid, frame_id, sum(e - b) AS covered FROM cm GROUP BY ALL) LEFT JOIN (SELECT tid, frame_id, sum(e - b) AS waiting FROM wm GROUP BY ALL) USING (tid, frame_id)",
    "occupancy_totals": _TYPED
    + _IN_FRAMES
    + """, pk AS (SELECT tid, peak, row_number() OVER (PARTITION BY tid ORDER BY n DESC, peak) AS k FROM (SELECT frame_id % 16 AS tid, peak, count(*) AS n FROM oc GROUP BY ALL))
SELECT frame_id % 16 AS tid, count(*) AS frames, sum(solo) AS solo, sum(others_work) AS others_work, sum("all") AS "all", sum(contended) AS contended, count(*) FILTER (WHERE contended > 0) AS contended_frames, max(pk.peak) AS threads_working FROM oc JOIN pk ON pk.tid = frame_id % 16 AND pk.k = 1 GROUP BY 1""",
}
