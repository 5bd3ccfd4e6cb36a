"""Queries over the event stream seen as scopes of threads: pairing, interval algebra and as-of joins.

A user's id modulo 16 is the thread, the event's type the timer, its time in microseconds the begin and its value in
minutes the length, so scopes of one thread nest and overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.asof import backward, forward
from chronoloom.operators.intervals import clipped, difference, merged, overlap_join, segments, sweep, union_length
from chronoloom.operators.pairing import last_begin_pairs, pairing_counts, queue_pairs, stack_pairs, with_parent
from chronoloom.operators.records import micros
from chronoloom.session import table

THREADS = 16
DAY = 86_400_000_000


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, id, spec, b, e: every event as a scope."""
    begin = micros(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(THREADS)).cast("long").alias("tid"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("spec"),
        begin.alias("b"),
        (begin + F.round(F.col("value") * 60e6).cast("long")).alias("e"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, seq, cycle, d: the scopes as one stream of begin and end records per thread."""
    sides = F.explode(F.array(F.struct(F.col("b").alias("cycle"), F.lit(1).alias("d")), F.struct(F.col("e").alias("cycle"), F.lit(-1).alias("d"))))
    rows = spans(spark, sf_dir).select("tid", "id", "spec", sides.alias("_r")).select("tid", "id", "spec", "_r.*")
    seq = F.row_number().over(Window.partitionBy("tid").orderBy("cycle", "d", "id"))
    return rows.withColumn("seq", seq.cast("long"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, day, b, e: the UTC days on which a thread has scopes, as windows."""
    return spans(spark, sf_dir).select("tid", F.expr(f"b - pmod(b, {DAY}L)").alias("b")).distinct().select("tid", (F.col("b") / DAY).cast("long").alias("day"), "b", (F.col("b") + DAY).alias("e"))


def lifo_scope_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stack_pairs(records(spark, sf_dir), ["tid"]).where("end_time is not null")
    return pairs.groupBy("tid", "level").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("end_time") - F.col("cycle")).alias("inclusive"))


def scope_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = with_parent(stack_pairs(records(spark, sf_dir), ["tid"]), ["tid"])
    return nested.groupBy("tid", "level").agg(F.count("parent").alias("enclosed"), F.sum("parent").alias("parents"))


def fifo_frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = queue_pairs(records(spark, sf_dir), ["tid"])
    return pairs.groupBy("tid").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("end") - F.col("begin")).alias("inclusive"), F.max(F.col("end") - F.col("begin")).alias("longest"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views open and purchases close, whatever stands between: unpaired records of both kinds."""
    kinds = F.when(F.col("spec") == "view", 1).when(F.col("spec") == "purchase", -1)
    return spans(spark, sf_dir).withColumn("d", kinds).where("d is not null").withColumn("seq", F.struct("b", "id"))


def pairing_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marks(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("tid").orderBy("b", "id")))
    return pairing_counts(rows, ["tid"])


def last_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = last_begin_pairs(_marks(spark, sf_dir), ["tid"], time="b", at="b")
    return pairs.groupBy("tid").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("end") - F.col("begin")).alias("waited"))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_length(spans(spark, sf_dir), ["tid"])


def interval_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spans(spark, sf_dir), ["tid", "spec"])


def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return difference(rows.where("spec = 'purchase'"), rows.where("spec <> 'purchase'"), ["tid"]).groupBy("tid").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("e") - F.col("b")).alias("solo"))


def sweep_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spans(spark, sf_dir), ["tid"])


def peak_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest peak over the days of each thread; ties go to the smaller peak."""
    peaks = sweep(_by_day(spark, sf_dir), ["tid", "day"]).groupBy("tid", "peak").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("tid").orderBy(F.col("n").desc(), "peak")
    return peaks.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes clipped to the days they overlap."""
    pairs = overlap_join(spans(spark, sf_dir), days(spark, sf_dir).select("tid", "day", "b", "e"), ["tid"])
    b, e = clipped(F.col("b"), F.col("e"), F.col("r_b"), F.col("r_e"))
    return pairs.select("tid", "day", "id", "spec", b.alias("b"), e.alias("e"))


def range_join_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_day(spark, sf_dir).groupBy("tid", "day").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("id").alias("scopes"), F.sum(F.col("e") - F.col("b")).alias("inclusive"))


def frame_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: the time thread 0 works alone, with others, the time others work, all covered time and the peak."""
    pieces = _by_day(spark, sf_dir)
    busy = segments(pieces, ["day", "tid"], {"n": F.lit(1)}).where("n > 0").select("day", "tid", F.col("t").alias("b"), F.col("until").alias("e"))
    own = (F.col("tid") == 0).cast("int")
    open_ = segments(busy, ["day"], {"own": own, "other": 1 - own})
    length = F.col("until") - F.col("t")
    when = lambda c: F.sum(F.when(c, length).otherwise(0))
    return open_.groupBy("day").agg(
        when((F.col("own") > 0) & (F.col("other") == 0)).alias("solo"),
        when((F.col("own") > 0) & (F.col("other") > 0)).alias("shared"),
        F.sum(F.col("other") * length).alias("others_work"),
        when(F.col("own") + F.col("other") > 0).alias("covered"),
        F.max(F.col("own") + F.col("other")).alias("peak"),
    )


def asof_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scope goes to the first day of its thread that ends at or after its end, if that has begun; clipped."""
    points = spans(spark, sf_dir)
    frames = days(spark, sf_dir).select("tid", "day", F.col("b").alias("f_b"), F.col("e").alias("f_e"))
    found = forward(points, frames, ["tid"], "e", "f_e", ["day"]).where("f_b <= e")
    return found.groupBy("tid", "day").agg(F.count(F.lit(1)).alias("scopes"), F.sum(F.col("e") - F.greatest("b", "f_b")).alias("inclusive"))


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of its thread at or before it."""
    rows = spans(spark, sf_dir)
    buys = rows.where("spec = 'purchase'").select("tid", "id", "b")
    views = rows.where("spec = 'view'").select("tid", F.col("id").alias("view_id"), F.col("b").alias("v_b"))
    return backward(buys, views, ["tid"], "b", "v_b", ["view_id"]).select("tid", "id", "view_id", (F.col("b") - F.col("v_b")).alias("waited"))


def task_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user: the last stamp of each kind and the value that came with the last of all."""
    rows = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("at")))
    return rows.groupBy("user_id").agg(last("view").alias("viewed"), last("purchase").alias("purchased"), F.max_by("value", F.struct("at", "event_id")).alias("last_value"))


_SPANS = f"""
WITH s AS (SELECT CAST(user_id % {THREADS} AS BIGINT) AS tid, event_id AS id, event_type AS spec, epoch_us(ts) AS b,
  epoch_us(ts) + CAST(round(value * 60e6) AS BIGINT) AS e FROM events)
"""
_RECORDS = (
    _SPANS
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY cycle, d, id) AS seq FROM (
  SELECT tid, id, b AS cycle, 1 AS d FROM s UNION ALL SELECT tid, id, e, -1 FROM s)),
x AS (SELECT *, sum(d) OVER (PARTITION BY tid ORDER BY seq) AS su FROM r),
y AS (SELECT *, least(0, min(su) OVER (PARTITION BY tid ORDER BY seq)) AS lo FROM x),
z AS (SELECT *, d = -1 AND su < coalesce(lag(lo) OVER (PARTITION BY tid ORDER BY seq), 0) AS bad, su - lo AS dep FROM y),
l AS (SELECT *, CASE WHEN d = 1 THEN dep ELSE dep + 1 END AS level FROM z WHERE NOT bad),
p AS (SELECT *, CASE WHEN lead(d) OVER w = -1 THEN lead(cycle) OVER w END AS end_time FROM l WINDOW w AS (PARTITION BY tid, level ORDER BY seq))
"""
)
_MARKS = (
    _SPANS
    + """,
m AS (SELECT *, CASE spec WHEN 'view' THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY tid ORDER BY b, id) AS seq
  FROM s WHERE spec IN ('view', 'purchase'))
"""
)
_DAYS = f""",
days AS (SELECT DISTINCT tid, b - b % {DAY} AS fb, b - b % {DAY} + {DAY} AS fe, (b - b % {DAY}) // {DAY} AS day FROM s),
c AS (SELECT s.tid, day, id, spec, greatest(b, fb) AS b, least(e, fe) AS e FROM s JOIN days ON s.tid = days.tid AND b < fe AND fb < e AND b < e)
"""
_STEPS = """
{name}_t AS (SELECT {by}, t, sum(n) AS n FROM (SELECT {by}, b AS t, 1 AS n FROM {of} WHERE b < e UNION ALL SELECT {by}, e, -1 FROM {of} WHERE b < e) GROUP BY ALL),
{name} AS (SELECT {by}, t, lead(t) OVER (PARTITION BY {by} ORDER BY t) AS u, sum(n) OVER (PARTITION BY {by} ORDER BY t) AS n FROM {name}_t)
"""
_UNION = """,
m AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s WHERE b < e),
i AS (SELECT *, sum(CASE WHEN b <= far THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT {by}, min(b) AS b, max(e) AS e FROM i GROUP BY {by}, island)
"""

QUERIES = {
    f.__name__: f
    for f in (lifo_scope_pairs, scope_parents, fifo_frame_pairs, pairing_counters, last_begin, interval_union, interval_merged, interval_difference, sweep_concurrency, peak_mode, range_join_frames, frame_occupancy, asof_frame, asof_backward, task_lifecycle)
}

ORACLES = {
    "lifo_scope_pairs": _RECORDS + "SELECT tid, level, count(*) AS pairs, sum(end_time - cycle) AS inclusive FROM p WHERE d = 1 AND end_time IS NOT NULL GROUP BY ALL",
    "scope_parents": _RECORDS
    + """SELECT a.tid, a.level, count(b.seq) AS enclosed, sum(b.seq) AS parents FROM (SELECT * FROM p WHERE d = 1) a
  ASOF LEFT JOIN (SELECT tid, level, seq FROM p WHERE d = 1) b ON a.tid = b.tid AND a.level - 1 = b.level AND a.seq >= b.seq GROUP BY ALL""",
    "fifo_frame_pairs": _SPANS
    + """,
b AS (SELECT tid, b AS cycle, row_number() OVER (PARTITION BY tid ORDER BY b, id) AS k FROM s),
e AS (SELECT tid, e AS cycle, row_number() OVER (PARTITION BY tid ORDER BY e, id) AS k FROM s)
SELECT b.tid, count(*) AS pairs, sum(e.cycle - b.cycle) AS inclusive, max(e.cycle - b.cycle) AS longest FROM b JOIN e USING (tid, k) GROUP BY ALL""",
    "pairing_counters": _MARKS
    + """,
x AS (SELECT *, sum(d) OVER (PARTITION BY tid ORDER BY seq) AS su FROM m),
y AS (SELECT tid, count(*) FILTER (WHERE d = 1) AS begins, count(*) FILTER (WHERE d = -1) AS ends, -least(0, min(su)) AS bad FROM x GROUP BY tid)
SELECT tid, ends - bad AS pairs, bad AS unpaired_ends, begins - (ends - bad) AS unpaired_begins FROM y""",
    "last_begin": _MARKS
    + """,
n AS (SELECT *, lag(d) OVER w AS ld, lag(b) OVER w AS lb FROM m WINDOW w AS (PARTITION BY tid ORDER BY seq))
SELECT tid, count(*) AS pairs, sum(b - lb) AS waited FROM n WHERE d = -1 AND ld = 1 GROUP BY ALL""",
    "interval_union": _SPANS + _UNION.format(by="tid") + "SELECT tid, count(*) AS pieces, sum(e - b) AS covered FROM u GROUP BY ALL",
    "interval_merged": _SPANS + _UNION.format(by="tid, spec") + "SELECT * FROM u",
    "interval_difference": _SPANS
    + """,
k AS (SELECT tid, t, sum(o) AS o, sum(x) AS x FROM (
  SELECT tid, b AS t, CAST(spec = 'purchase' AS INT) AS o, CAST(spec <> 'purchase' AS INT) AS x FROM s WHERE b < e
  UNION ALL SELECT tid, e, -CAST(spec = 'purchase' AS INT), -CAST(spec <> 'purchase' AS INT) FROM s WHERE b < e) GROUP BY ALL),
q AS (SELECT tid, t, lead(t) OVER w AS u, sum(o) OVER w AS o, sum(x) OVER w AS x FROM k WINDOW w AS (PARTITION BY tid ORDER BY t)),
v AS (SELECT *, o > 0 AND x = 0 AS own FROM q WHERE u IS NOT NULL),
f AS (SELECT *, own AND NOT coalesce(lag(own) OVER (PARTITION BY tid ORDER BY t), false) AS fresh FROM v)
SELECT tid, count(*) FILTER (WHERE fresh) AS pieces, sum(u - t) AS solo FROM f WHERE own GROUP BY ALL""",
    "sweep_concurrency": _SPANS
    + ","
    + _STEPS.format(name="w", by="tid", of="s")
    + "SELECT tid, sum(CASE WHEN n > 0 THEN u - t ELSE 0 END) AS covered, max(n) AS peak, sum(CASE WHEN n > 1 THEN u - t ELSE 0 END) AS contended FROM w WHERE u IS NOT NULL GROUP BY ALL",
    "peak_mode": _SPANS
    + _DAYS
    + ","
    + _STEPS.format(name="w", by="tid, day", of="c")
    + """,
k AS (SELECT tid, peak, count(*) AS n FROM (SELECT tid, day, max(n) AS peak FROM w WHERE u IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT tid, peak, n FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, peak) AS k FROM k) WHERE k = 1""",
    "range_join_frames": _SPANS + _DAYS + "SELECT tid, day, count(*) AS pieces, count(DISTINCT id) AS scopes, sum(e - b) AS inclusive FROM c GROUP BY ALL",
    "frame_occupancy": _SPANS
    + _DAYS
    + ","
    + _STEPS.format(name="w", by="day, tid", of="c")
    + """,
busy AS (SELECT day, tid, t AS b, u AS e FROM w WHERE n > 0 AND u IS NOT NULL),
k AS (SELECT day, t, sum(o) AS o, sum(x) AS x FROM (
  SELECT day, b AS t, CAST(tid = 0 AS INT) AS o, CAST(tid <> 0 AS INT) AS x FROM busy UNION ALL SELECT day, e, -CAST(tid = 0 AS INT), -CAST(tid <> 0 AS INT) FROM busy) GROUP BY ALL),
q AS (SELECT day, t, lead(t) OVER w2 AS u, sum(o) OVER w2 AS o, sum(x) OVER w2 AS x FROM k WINDOW w2 AS (PARTITION BY day ORDER BY t))
SELECT day, sum(CASE WHEN o > 0 AND x = 0 THEN u - t ELSE 0 END) AS solo, sum(CASE WHEN o > 0 AND x > 0 THEN u - t ELSE 0 END) AS shared,
  sum(x * (u - t)) AS others_work, sum(CASE WHEN o + x > 0 THEN u - t ELSE 0 END) AS covered, max(o + x) AS peak FROM q WHERE u IS NOT NULL GROUP BY ALL""",
    "asof_frame": _SPANS
    + _DAYS
    + """,
a AS (SELECT s.tid, s.b, s.e, min(fe) AS fe FROM s JOIN days ON s.tid = days.tid AND fe >= s.e GROUP BY s.tid, s.id, s.b, s.e)
SELECT a.tid, day, count(*) AS scopes, sum(a.e - greatest(a.b, fb)) AS inclusive FROM a JOIN days ON a.tid = days.tid AND a.fe = days.fe WHERE fb <= a.e GROUP BY ALL""",
    "asof_backward": _SPANS
    + """SELECT p.tid, p.id, v.id AS view_id, p.b - v.b AS waited FROM (SELECT * FROM s WHERE spec = 'purchase') p
  LEFT JOIN LATERAL (SELECT id, b FROM s WHERE s.spec = 'view' AND s.tid = p.tid AND s.b <= p.b ORDER BY s.b DESC, s.id DESC LIMIT 1) v ON true""",
    "task_lifecycle": """SELECT user_id, max(epoch_us(ts)) FILTER (WHERE event_type = 'view') AS viewed, max(epoch_us(ts)) FILTER (WHERE event_type = 'purchase') AS purchased,
  arg_max(value, (epoch_us(ts), event_id)) AS last_value FROM events GROUP BY user_id""",
}
