"""Queries over tasks: the lines of an order are tasks, each waiting for the ones before it.

A line is created with its order, started when it ships and finished as many minutes later as its quantity; returned lines
never start, and those with line status F and tax 0 never finish. A line depends on the one before it, the third on the
first too, and in every fiftieth order the first depends on the last: a ring. Ten kinds of events come of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import tasks as op
from chronoloom.operators.graph import chains_to, longest_chains
from chronoloom.operators.records import micros
from chronoloom.session import cut_lineage, table

MINUTE = 60_000_000
RING = 50
TOP = 40


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once: order, n, tid, id, created, shipped, quantity, returned, open."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("n")).agg(
        F.min(F.struct(micros(F.col("l_shipdate")).alias("shipped"), "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax", "l_partkey")).alias("_l")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), micros(F.col("o_orderdate")).alias("ordered"))
    rows = lines.select("order_id", "n", "_l.*").join(orders, "order_id")
    return rows.select(
        "order_id", "n", (F.col("order_id") * 16 + F.col("n")).alias("id"), F.pmod("l_suppkey", F.lit(8)).cast("long").alias("tid"), "ordered", "shipped",
        (F.col("l_quantity").cast("long") * MINUTE).alias("took"), (F.col("l_returnflag") == "R").alias("returned"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)).alias("endless"), F.col("l_partkey").alias("part"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, tid, seq, kind, task, other, stamp, size, text, execute_on, tracked: the events of all lines."""
    said = lambda kind, stamp, when=None, other=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("kind"), stamp.alias("stamp"), (F.lit(None).cast("long") if other is None else other).alias("other")))
    runs, ends = ~F.col("returned"), ~F.col("returned") & ~F.col("endless")
    finished = F.col("shipped") + F.col("took")
    kinds = [
        said("Created", F.col("ordered")),
        said("Launched", F.col("ordered") + 1),
        said("Scheduled", F.col("ordered") + 2, F.col("n") != 4),
        said("WaitingStarted", F.col("shipped") - MINUTE, F.col("part") % 3 == 0),
        said("WaitingFinished", F.col("shipped"), F.col("part") % 6 < 4),
        said("Started", F.col("shipped"), runs),
        said("Finished", finished, ends),
        said("Completed", finished + 1, ends),
        said("Destroyed", finished + 2, ends & (F.col("part") % 2 == 0)),
    ]
    rows = _lines(spark, sf_dir).withColumn("last", F.max("n").over(Window.partitionBy("order_id")))
    edges = [
        said("SubsequentAdded", F.col("ordered"), F.col("n") < F.col("last"), F.col("id") + 1),
        said("SubsequentAdded", F.col("ordered"), (F.col("n") == 1) & (F.col("last") >= 3), F.col("id") + 2),
        said("SubsequentAdded", F.col("ordered"), (F.col("n") == F.col("last")) & (F.col("last") >= 3) & (F.col("order_id") % RING == 0), F.col("order_id") * 16 + 1),
    ]
    every = F.filter(F.array(*kinds, *edges), lambda x: x.isNotNull())
    rows = rows.select("order_id", "tid", "id", "part", "took", F.posexplode(every).alias("at", "_e")).select("order_id", "tid", "id", "part", "took", "at", "_e.*")
    launched = F.col("kind") == "Launched"
    return rows.select(
        "order_id", "tid", (F.col("id") * 16 + F.col("at")).alias("seq"), "kind", F.when(~F.col("kind").startswith("Waiting"), F.col("id")).alias("task"), "other", "stamp",
        F.when(F.col("kind").isin("Created", "Launched"), F.col("took")).alias("size"), F.when(launched, F.concat(F.lit("part "), "part")).alias("text"),
        F.when(launched, F.col("part") % 256).alias("execute_on"), F.when(launched, F.col("part") % 2 == 1).alias("tracked"),
    )


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each task, folded from nine kinds of events, with how long it ran."""
    return op.lifecycle(task_events(spark, sf_dir), ["order_id"]).withColumn("duration", op.duration())


def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: events, tasks, edges, waits, unfinished tasks and events that say nothing."""
    events = cut_lineage(task_events(spark, sf_dir))
    waits, unread = op.waits(events, [])
    counted = events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct(F.when(F.col("kind").isin(*op.STAMPS), F.col("task"))).alias("tasks"), F.count_if(F.col("kind") == op.EDGE).alias("edges"))
    unfinished = op.lifecycle(events, []).agg(F.count_if(F.col("started").isNotNull() & F.col("finished").isNull()).alias("unfinished"))
    return counted.crossJoin(waits.agg(F.count(F.lit(1)).alias("waits"))).crossJoin(unfinished).crossJoin(unread)  # rows of one


def task_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits per thread: how many, how long in all and the longest."""
    waits, _ = op.waits(task_events(spark, sf_dir), [])
    took = F.col("end") - F.col("begin")
    return waits.groupBy("tid").agg(F.count(F.lit(1)).alias("waits"), F.sum(took).alias("waited"), F.max(took).alias("longest"))


def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task with how many it depends on, how many depend on it, and the first of both."""
    events = cut_lineage(task_events(spark, sf_dir))
    tasks = op.lifecycle(events, []).select("task")
    made = op.linked(tasks, op.edges(events, []), [])
    return made.select("task", F.size("prerequisites").alias("before"), F.size("subsequents").alias("after"), F.try_element_at("prerequisites", F.lit(1)).alias("first_before"), F.try_element_at("subsequents", F.lit(1)).alias("first_after"))


def top_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the tasks that ran longest, with how many of their edges stay among them; never run: last."""
    events = cut_lineage(task_events(spark, sf_dir))
    tasks = op.lifecycle(events, []).withColumn("duration", op.duration())
    kept = cut_lineage(tasks.orderBy(F.col("duration").desc_nulls_last(), "task").limit(op.KEPT))
    inside = op.among(op.edges(events, []), kept, []).groupBy(F.col("pred").alias("task")).agg(F.count(F.lit(1)).alias("edges"))
    return kept.join(inside, "task", "left").select("task", "name", "duration", F.coalesce("edges", F.lit(0)).alias("edges"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cut_lineage(task_events(spark, sf_dir))
    tasks = op.lifecycle(events, ["order_id"]).select("order_id", F.col("task").alias("id"), op.duration().alias("duration"))
    return longest_chains(tasks.select("id", "duration"), op.edges(events, []))


def task_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of each order, over branches and rings: its last task, total, and how many tasks it has."""
    best = _chains(spark, sf_dir)
    winner = F.max_by(F.struct("id", "total", "steps"), F.struct("total", -F.col("id"))).alias("_w")
    return best.groupBy(F.expr("id div 16").alias("order_id")).agg(winner).select("order_id", F.col("_w.id").alias("last"), "_w.total", "_w.steps")


def task_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the longest chain of all, oldest first, each with the day of its thread that holds its begin."""
    best = cut_lineage(_chains(spark, sf_dir))
    last = best.orderBy(F.col("total").desc(), "id").limit(1).select("id")
    tasks = op.lifecycle(task_events(spark, sf_dir), []).select(F.col("task").alias("id"), F.col("started_tid").alias("tid"), F.col("started").alias("begin"), op.duration().alias("duration"))
    steps = chains_to(best, last).join(tasks, "id")
    day = 86_400_000_000
    frames = _lines(spark, sf_dir).select("tid", F.expr(f"shipped - pmod(shipped, {day}L)").alias("b")).distinct().select("tid", "b", (F.col("b") + day - 1).alias("e"), F.expr(f"b div {day}L").alias("frame_id"))
    return op.placed(steps, frames, []).select("place", "id", "duration", "frame_id")


QUERIES = {f.__name__: f for f in (task_states, task_counts, task_waits, task_edges, top_tasks, task_chains, task_path)}

_EVENTS = f"""
WITH RECURSIVE l0 AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS n, min(ROW(epoch_us(l_shipdate), l_suppkey, l_quantity, l_returnflag, l_linestatus, l_tax, l_partkey)) AS l FROM lineitem GROUP BY ALL),
l AS (SELECT order_id, n, order_id * 16 + n AS id, CAST(l[2] % 8 AS BIGINT) AS tid, epoch_us(o_orderdate) AS ordered, l[1] AS shipped, CAST(l[3] AS BIGINT) * {MINUTE} AS took, l[4] = 'R' AS returned, l[5] = 'F' AND l[6] = 0 AS endless, l[7] AS part,
  max(n) OVER (PARTITION BY order_id) AS last FROM l0 JOIN orders ON o_orderkey = order_id),
t AS (SELECT order_id, id AS task, CASE WHEN NOT returned THEN shipped END AS started, CASE WHEN NOT returned AND NOT endless THEN shipped + took END AS finished, ordered, n, part, took, tid, shipped FROM l),
d AS (SELECT *, finished - started AS duration FROM t),
e AS (SELECT DISTINCT order_id, id AS pred, id + 1 AS succ, n, last FROM l WHERE n < last UNION SELECT order_id, id, id + 2, n, last FROM l WHERE n = 1 AND last >= 3
  UNION SELECT order_id, id, order_id * 16 + 1, n, last FROM l WHERE n = last AND last >= 3 AND order_id % {RING} = 0),
w AS (SELECT tid, id, 1 AS d, shipped - {MINUTE} AS s FROM l WHERE part % 3 = 0 UNION ALL SELECT tid, id, -1, shipped FROM l WHERE part % 6 < 4),
p AS (SELECT *, lag(d) OVER o AS ld, lag(s) OVER o AS ls, lead(d) OVER o AS nd FROM w WINDOW o AS (PARTITION BY tid ORDER BY id, d DESC)),
ke AS (SELECT e.* FROM e JOIN d a ON a.task = e.pred JOIN d b ON b.task = e.succ WHERE b.duration IS NOT NULL)
"""
# in an order whose ring is whole (all tasks ran; the second may be passed by) no edge of its first task leads on
_PATHS = """,
rg AS (SELECT l.order_id FROM l JOIN d ON d.task = l.id WHERE l.last >= 3 AND l.order_id % 50 = 0 AND l.n <> 2 GROUP BY l.order_id HAVING count(*) = max(l.last) - 1 AND bool_and(d.duration IS NOT NULL)),
ac AS (SELECT ke.pred, ke.succ FROM ke LEFT JOIN rg USING (order_id) WHERE NOT (rg.order_id IS NOT NULL AND ke.n = 1)),
walk(id, total, steps) AS (SELECT task, coalesce(duration, 0), 1 FROM d WHERE task NOT IN (SELECT succ FROM ac)
  UNION ALL SELECT ac.succ, walk.total + d.duration, walk.steps + 1 FROM walk JOIN ac ON ac.pred = walk.id JOIN d ON d.task = ac.succ),
best AS (SELECT id, max(total) AS total FROM walk GROUP BY id),
par AS (SELECT ac.succ AS id, ac.pred, row_number() OVER (PARTITION BY ac.succ ORDER BY best.total DESC, ac.pred) AS k FROM ac JOIN best ON best.id = ac.pred),
chain(last, id, back) AS (SELECT id, id, 1 FROM best UNION ALL SELECT chain.last, par.pred, back + 1 FROM chain JOIN par ON par.id = chain.id AND par.k = 1),
len AS (SELECT last AS id, max(back) AS steps FROM chain GROUP BY last)
"""
ORACLES = {
    "task_states": _EVENTS
    + """SELECT order_id, task, ordered AS created, ordered + 1 AS launched, CASE WHEN n <> 4 THEN ordered + 2 END AS scheduled, started, finished, finished + 1 AS completed, CASE WHEN part % 2 = 0 THEN finished + 2 END AS destroyed,
  'part ' || part AS name, took AS size, part % 256 AS execute_on, part % 2 = 1 AS tracked, CASE WHEN started IS NOT NULL THEN tid END AS started_tid, CASE WHEN finished IS NOT NULL THEN tid END AS finished_tid, duration FROM d""",
    "task_counts": _EVENTS
    + """, k AS (SELECT sum(3 + CAST(n <> 4 AS INT) - 1 + CAST(part % 3 = 0 AS INT) + CAST(part % 6 < 4 AS INT) + CAST(started IS NOT NULL AS INT) + CASE WHEN finished IS NOT NULL THEN 2 + CAST(part % 2 = 0 AS INT) ELSE 0 END) AS n FROM d)
SELECT (SELECT n FROM k) + (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM d) AS tasks, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM p WHERE d = -1 AND ld = 1) AS waits,
  (SELECT count(*) FROM d WHERE started IS NOT NULL AND finished IS NULL) AS unfinished, (SELECT count(*) FROM p WHERE d = -1 AND coalesce(ld, -1) = -1) + (SELECT count(*) FROM p WHERE d = 1 AND nd IS NULL) AS unreadable""",
    "task_waits": _EVENTS + "SELECT tid, count(*) AS waits, sum(s - ls) AS waited, max(s - ls) AS longest FROM p WHERE d = -1 AND ld = 1 GROUP BY tid",
    "task_edges": _EVENTS
    + """SELECT task, coalesce(b.c, 0) AS before, coalesce(a.c, 0) AS after, b.m AS first_before, a.m AS first_after FROM d LEFT JOIN (SELECT succ, count(*) AS c, min(pred) AS m FROM e GROUP BY succ) b ON b.succ = task
  LEFT JOIN (SELECT pred, count(*) AS c, min(succ) AS m FROM e GROUP BY pred) a ON a.pred = task""",
    "top_tasks": _EVENTS
    + f""", x AS (SELECT task, 'part ' || part AS name, duration FROM d ORDER BY duration DESC NULLS LAST, task LIMIT {op.KEPT})
SELECT x.*, (SELECT count(*) FROM e WHERE e.pred = x.task AND e.succ IN (SELECT task FROM x)) AS edges FROM x""",
    "task_chains": _EVENTS + _PATHS + "SELECT id // 16 AS order_id, arg_max(id, (total, -id)) AS last, max(total) AS total, arg_max(steps, (total, -id)) AS steps FROM best JOIN len USING (id) GROUP BY 1",
    "task_path": _EVENTS
    + _PATHS
    + """, win AS (SELECT id FROM best ORDER BY total DESC, id LIMIT 1)
SELECT len.steps - back + 1 AS place, chain.id, duration, CASE WHEN started IS NOT NULL THEN started // 86400000000 END AS frame_id FROM chain JOIN win ON chain.last = win.id JOIN len ON len.id = win.id JOIN d ON d.task = chain.id""",
}
