"""What a capture's numbers add up to: its metrics, two captures against each other, findings, and what it can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import contains_any, strict_cap
from chronoloom.operators.dist import busiest
from chronoloom.plans import captures as cap
from chronoloom.plans import sources as src
from chronoloom.plans.captures import _FR, _WORDS, BUDGET
from chronoloom.session import cut_lineage, table

THRESHOLD = 0.05
OVER, HALF, TAIL, OWNER, SOLO, CAPPED, THIN = 0.05, 0.5, 2.0, 0.25, 0.80, 0.25, 100
# fixed values: fragments of timer names that tell of streaming
STREAMING = ("asyncloading", "flushasyncloading", "loadpackage", "loadtime", "asyncpackage")
SEVERITY, CONFIDENCE, EFFORT = ("high", "medium", "low"), ("certain", "heuristic", "unknown"), ("low", "medium", "high")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed frames of the busiest series of each capture."""
    rows = cut_lineage(cap.frames(spark, sf_dir).where("end_cycle > begin_cycle").select("capture_id", "tid", "frame_type", "begin_cycle", "end_cycle", "ms"))
    return rows.join(busiest(rows, ["capture_id"], ["tid", "frame_type"]).select("capture_id", "tid", "frame_type"), ["capture_id", "tid", "frame_type"], "left_semi")


def _distribution(rows: DataFrame) -> DataFrame:
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by ms)")
    return rows.where("ms is not null").groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("ms").alias("most"), F.count_if(F.col("ms") > BUDGET).alias("over"), F.count_if(F.col("ms") > 2 * BUDGET).alias("hitches")
    )


def _capped(rows: DataFrame) -> DataFrame:
    """capture_id, share, multiple: the commonest small multiple of a display period that frames lie on; of equals the smaller multiple, then the first period."""
    on = rows.where("ms is not null").withColumn("_c", strict_cap(F.col("ms") / 1000.0))
    each = on.groupBy("capture_id", "_c").agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.struct("_n", "_c.multiple"), F.when(F.col("_c").isNotNull(), F.struct("_n", -F.col("_c.multiple"), -F.col("_c.period")))).alias("_b")
    return each.groupBy("capture_id").agg(best, F.sum("_n").alias("_all")).where("_b is not null").select("capture_id", (F.col("_b._n") / F.col("_all")).alias("cap_share"), F.col("_b.multiple").alias("cap_multiple"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a capture with everything the rules ask; null is not measured."""
    rows = cut_lineage(_series(spark, sf_dir))
    named = src.timers(spark, sf_dir).select("capture_id", "spec", "name")
    kept = cut_lineage(src._kept(spark, sf_dir))
    span = cap._kept_frames(spark, sf_dir).groupBy("capture_id").agg(F.sum(F.col("end_cycle") - F.col("begin_cycle")).alias("_span"))
    loads = src.pattern_presence(spark, sf_dir).where("pattern = 'sync-load'").select("capture_id", F.col("owned").alias("_loads"))
    streaming = kept.where("over").join(named, ["capture_id", "spec"]).groupBy("capture_id", "frame_id").agg((F.sum(F.when(contains_any(F.coalesce("name", F.lit("")), STREAMING), F.col("cycles")).otherwise(0)) / F.sum("cycles")).alias("_s"))
    verdicts = cap.bottleneck_verdicts(spark, sf_dir).groupBy("capture_id").agg(F.max_by("verdict", F.struct("n", "verdict")).alias("leader"), F.max("n").alias("led"), F.sum("n").alias("judged"))
    nodes = cap.once(spark, sf_dir, "nodes", "node_id").groupBy("capture_id").agg(F.count_if(F.col("spec").isNull()).alias("specless"))
    gpu = cap.once_gpu_frames(spark, sf_dir).groupBy("capture_id").agg(F.count(F.lit(1)).alias("gpu_frames"), F.sum(F.col("unbalanced") + F.col("truncated")).alias("_odd"))
    types = table(spark, sf_dir, "event_types").dropDuplicates(["capture_id", "seq"]).groupBy("capture_id").agg(F.count_if(F.col("fields").isNull()).alias("_broken"), F.count_if(F.col("logger") == "TaskTrace").alias("task_types"))
    values = table(spark, sf_dir, "csv_values").groupBy("capture_id").agg(F.count(F.lit(1)).alias("csv_values"))
    lone = cap.parallelism_threads(spark, sf_dir).select("capture_id", (F.col("solo") / F.nullif(F.col("solo") + F.col("shared"), F.lit(0))).alias("solo_share"), "threads_working")
    first = cap.candidates(spark, sf_dir).where("place = 1").select("capture_id", F.col("share").alias("owner_share"), F.col("name").alias("owner"))
    out = cap.captures(spark, sf_dir).select("capture_id", "cycle_frequency")
    parts = (
        rows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("frames")), _distribution(rows), _capped(rows), verdicts, first, lone, nodes, gpu, types, values,
        span.join(loads, "capture_id").select("capture_id", (F.col("_loads") / F.col("_span")).alias("load_share")), streaming.groupBy("capture_id").agg(F.max("_s").alias("streaming_share")),
    )
    for part in parts:
        out = out.join(part, "capture_id", "left")
    return out.withColumn("anomalies", F.coalesce("_odd", F.lit(0)) + F.coalesce("_broken", F.lit(0)))


def _rules(stats: int, explicit_budget: bool) -> list[tuple[str | Column, str | Column, str, str, Column, Column]]:
    """(rule, severity, effort, confidence, fires, evidence) in the order of the report."""
    c, zero = F.col, F.lit(0.0)
    share = c("over") / F.nullif("n", F.lit(0))
    majority = F.when(c("led") * 2 > c("judged"), "high").otherwise("medium")
    none = lambda name: F.coalesce(c(name), F.lit(0)) == 0
    return [
        ("budget-default", "low", "low", "certain", F.lit(not explicit_budget), F.lit(BUDGET)),
        ("no-frames", "high", "low", "unknown", none("frames"), zero),
        ("no-frequency", "high", "low", "certain", ~none("frames") & none("cycle_frequency"), zero),
        ("frame-cap", "high", "low", "heuristic", c("cap_share") >= CAPPED, c("cap_share")),
        ("over-budget", F.when(share > HALF, "high").otherwise("medium"), "medium", "certain", share >= OVER, share),
        ("tail-vs-mean", "medium", "medium", "certain", (c("over") > 0) & (c("p50") > 0) & (c("p99") >= TAIL * c("p50")), c("p99") / c("p50")),
        ("hitches", "medium", "medium", "certain", c("hitches") >= 1, c("hitches")),
        ("thin-sample", "low", "low", "certain", c("n") < THIN, c("n")),
        ("bound-thread", majority, "medium", "certain", (c("led") > 0) & (c("leader") != "unexplained"), c("led") / c("judged")),
        ("bound-unexplained", majority, "medium", "unknown", (c("led") > 0) & (c("leader") == "unexplained"), c("led") / c("judged")),
        ("one-timer", "high", "medium", "heuristic", c("owner_share") >= OWNER, c("owner_share")),
        ("workers-idle", "high", "high", "certain", (c("threads_working") >= 2) & (c("solo_share") >= SOLO), c("solo_share")),
        ("sync-load", "medium", "high", "heuristic", c("load_share") >= OVER, c("load_share")),
        ("async-loading", "medium", "high", "heuristic", c("streaming_share") >= OWNER, c("streaming_share")),
        ("gpu-unknown", "medium", "low", "unknown", none("gpu_frames"), zero),
        ("task-unknown", "low", "low", "unknown", none("task_types"), zero),
        ("csv-no-values", "low", "medium", "certain", none("csv_values") & F.lit(stats > 0), F.lit(float(stats))),
        ("attribution-gaps", "low", "medium", "certain", c("specless") > 0, c("specless")),
        ("anomalies", "medium", "low", "certain", c("anomalies") > 0, c("anomalies")),
    ]


def advice_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, place, rule, severity, effort, confidence, evidence: the rules that fire on a capture, ranked.

    Ranked by severity, then confidence, then effort, then the rule's name. Findings of no measurement do not fire.
    """
    stats = table(spark, sf_dir, "csv_stats").count()
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    packed = F.array(*[F.when(fires, F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), F.lit(effort).alias("effort"), F.lit(sure).alias("confidence"), F.round(evidence.cast("double"), 6).alias("evidence"))) for rule, severity, effort, sure, fires, evidence in _rules(stats, False)])
    found = _facts(spark, sf_dir).select("capture_id", F.explode(F.filter(packed, lambda x: x.isNotNull())).alias("_f")).select("capture_id", "_f.*")
    ordinal = lambda name, names: F.array_position(F.array(*map(F.lit, names)), F.col(name))
    order = Window.partitionBy("capture_id").orderBy(ordinal("severity", SEVERITY), ordinal("confidence", CONFIDENCE), ordinal("effort", EFFORT), "rule")
    return found.withColumn("place", F.row_number().over(order))


def metric_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, section, key, unit, lower_is_better, value: every comparable number of a capture that was measured."""
    rows = cut_lineage(_series(spark, sf_dir))
    work = cap.once(spark, sf_dir, "nodes", "node_id").groupBy("capture_id").agg(F.count("spec").alias("pairs"), (F.count_if(F.col("spec").isNull()) / F.count(F.lit(1))).alias("lost"))
    lone = cap.parallelism_threads(spark, sf_dir).select("capture_id", (F.col("solo") / F.nullif(F.col("solo") + F.col("shared"), F.lit(0))).alias("solo"), "threads_working")
    files = src.timers(spark, sf_dir).groupBy("capture_id").agg((F.count("path") / F.count(F.lit(1))).alias("located"), F.countDistinct("path").alias("files"))
    number = lambda name: F.col(name).cast("double")

    def said(df: DataFrame, section: str, *metrics: tuple[str, str, bool, Column]) -> DataFrame:
        packed = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(f"{section}.{key}").alias("key"), F.lit(unit).alias("unit"), F.lit(lower).alias("lower_is_better"), value.alias("value")) for key, unit, lower, value in metrics])
        return df.select("capture_id", F.explode(packed).alias("_m")).select("capture_id", "_m.*").where("value is not null")

    return (
        said(_distribution(rows), "frames", ("count", "count", False, number("n")), ("p50_ms", "ms", True, F.col("p50")), ("p95_ms", "ms", True, F.col("p95")), ("p99_ms", "ms", True, F.col("p99")), ("max_ms", "ms", True, F.col("most")), ("over", "count", True, number("over")), ("hitches", "count", True, number("hitches")))
        .unionByName(said(work, "work", ("pairs", "count", False, number("pairs")), ("unattributed_share", "share", True, F.round("lost", 6))))
        .unionByName(said(lone, "occupancy", ("solo_share", "share", True, F.round("solo", 6)), ("threads_working", "threads", False, number("threads_working"))))
        .unionByName(said(files, "sources", ("located_share", "share", False, F.round("located", 6)), ("files", "count", False, number("files"))))
    )


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each app's first capture against its last, metric by metric: delta, direction and whether it breaks the gate.

    Both sides hold what was measured in them, so a metric may be missing on either: then there is no ratio, and 'unknown'.
    """
    order = F.struct("started_at", "capture_id")
    ends = cap.captures(spark, sf_dir).groupBy("app").agg(F.min_by("capture_id", order).alias("before_id"), F.max_by("capture_id", order).alias("after_id"))
    metrics = cut_lineage(metric_vector(spark, sf_dir).select("capture_id", "key", "lower_is_better", "value"))
    side = lambda id_, low, value: ends.select("app", F.col(id_).alias("capture_id")).join(metrics, "capture_id").select("app", "key", F.col("lower_is_better").alias(low), F.col("value").alias(value))
    joined = side("before_id", "_low", "before").join(side("after_id", "_low2", "after"), ["app", "key"], "full")
    joined = joined.withColumn("ratio", F.round((F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)), 6)).withColumn("_lower", F.coalesce("_low", "_low2"))
    worse = F.when(F.col("_lower"), F.col("ratio")).otherwise(-F.col("ratio"))
    verdict = F.when(F.col("ratio").isNull(), "unknown").when(worse > THRESHOLD, "worse").when(worse < -THRESHOLD, "better").otherwise("same")
    return joined.withColumn("verdict", verdict).select("app", "key", "before", "after", "ratio", "verdict")


# fixed values: the analyses, and the channels that each cannot do without
ANALYSES = (
    ("frame times", ("cpu", "frame")), ("cpu root cause", ("cpu",)), ("thread occupancy", ("cpu",)), ("task graph", ("task",)), ("gpu", ("gpu",)), ("bookmarks", ("bookmark",)),
    ("regions", ("region",)), ("log", ("log",)), ("counters", ("counters",)), ("csv series", ("counters",)), ("memory", ("memtag", "memalloc")), ("loading", ("loadtime", "file")),
)
#: Which declared loggers stand for which channels of the registry here.
REGISTRY = {"Memo": ("memtag", "memalloc"), "Load": ("loadtime", "file"), "World": ("region",), "Render": ("gpu",), "Script": ("cpu",)}
MODELLED = ("cpu", "frame", "gpu", "task", "counters", "bookmark", "log")
MEMORY = ("memtag", "memalloc")


def channel_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, channel, enabled, held, ready, note: what the registry of a capture says, beside what the tables hold.

    held is null for channels that no table models: there the registry alone decides. Ready channels come first, then by name.
    """
    pairs = [(k, c) for k, channels in REGISTRY.items() for c in channels]
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("logger"), F.lit(c).alias("channel")) for k, c in pairs])).alias("_p")
    every = spark.range(1).select(said).select("_p.*")
    registry = table(spark, sf_dir, "event_types").select("capture_id", "logger").distinct().join(every, "logger").select("capture_id", "channel").distinct().withColumn("enabled", F.lit(True))
    count = lambda name, key: table(spark, sf_dir, name).groupBy("capture_id").agg(F.countDistinct(key).alias("held"))
    held = count("nodes", "spec").withColumn("channel", F.lit("cpu"))
    gpu = count("gpu_frames", "gpu_frame_id").unionByName(count("gpu_spans", "span_id")).groupBy("capture_id").agg(F.sum("held").alias("held"))
    for rows, channel in ((count("frames", "frame_id"), "frame"), (gpu, "gpu"), (count("csv_values", "value_id"), "counters")):
        held = held.unionByName(rows.withColumn("channel", F.lit(channel)))
    joined = registry.join(held, ["capture_id", "channel"], "full")
    modelled = F.col("channel").isin(*MODELLED)
    own = F.when(modelled, F.coalesce("held", F.lit(0)))
    joined = joined.withColumn("enabled", F.coalesce("enabled", F.lit(False))).withColumn("held", own).where("enabled or held > 0").withColumn("ready", F.coalesce(F.col("held") > 0, F.col("enabled")))
    note = F.when(F.col("enabled") & (F.col("held") == 0), "recorded, but nothing is held").when(~F.col("enabled"), "not in the registry: its events are the evidence").otherwise("")
    return joined.withColumn("note", note).orderBy("capture_id", (~F.col("ready")).cast("int"), "channel")


def coverage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, analysis, ready, missing, again: what each capture can answer, the channels it lacks and the preset that records them."""
    needs = F.array(*[F.struct(F.lit(a).alias("analysis"), F.array(*map(F.lit, n)).alias("needs")) for a, n in ANALYSES])
    ready = channel_states(spark, sf_dir).where("ready").groupBy("capture_id").agg(F.collect_set("channel").alias("_have"))
    rows = cap.captures(spark, sf_dir).select("capture_id").join(ready, "capture_id", "left").select("capture_id", F.coalesce("_have", F.array().cast("array<string>")).alias("_have"), F.explode(needs).alias("_a"))
    missing = F.filter("_a.needs", lambda c: ~F.array_contains("_have", c))
    memory = F.exists(missing, lambda c: c.isin(*MEMORY))
    other = F.exists(missing, lambda c: ~c.isin(*MEMORY))
    again = F.array_join(F.filter(F.array(F.when(memory, "Memory"), F.when(other, "Default")), lambda x: x.isNotNull()), " and ")
    return rows.select("capture_id", "_a.analysis", (F.size(missing) == 0).alias("ready"), F.array_join(F.array_sort(missing), ",").alias("missing"), again.alias("again"))


QUERIES = {f.__name__: f for f in (advice_findings, metric_vector, ab_compare, channel_states, coverage_verdicts)}

_O = {**cap.ORACLES, **src.ORACLES}
_DISTRIBUTED = (
    _FR
    + f""", cl AS (SELECT * FROM fr WHERE end_cycle > begin_cycle), bz AS (SELECT capture_id, tid, frame_type, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, tid, frame_type) AS k FROM cl GROUP BY capture_id, tid, frame_type),
se AS (SELECT cl.* FROM cl JOIN bz USING (capture_id, tid, frame_type) WHERE k = 1),
di AS (SELECT capture_id, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, max(ms) AS most, count(*) FILTER (WHERE ms > {BUDGET!r}) AS over, count(*) FILTER (WHERE ms > {2 * BUDGET!r}) AS hitches FROM se WHERE ms IS NOT NULL GROUP BY ALL)"""
)
_MULT = lambda p: f"round_even(ms / 1000.0 / (1.0::DOUBLE / {p}), 0)"
_ON = lambda p: f"{_MULT(p)} BETWEEN 1 AND 4 AND abs(ms / 1000.0 - {_MULT(p)} * (1.0::DOUBLE / {p})) <= 0.05 * (1.0::DOUBLE / {p})"
_FACTS = (
    _DISTRIBUTED
    + f""", cz AS (SELECT capture_id, CASE {" ".join(f"WHEN {_ON(p)} THEN {i * 10} + {_MULT(p)}" for i, p in enumerate((60, 30, 120, 90)))} END AS z FROM se WHERE ms IS NOT NULL),
cs AS (SELECT capture_id, max(c) FILTER (WHERE z IS NOT NULL) / sum(c) AS cap_share FROM (SELECT capture_id, z, count(*) AS c FROM cz GROUP BY ALL) GROUP BY ALL),
bv AS (SELECT capture_id, arg_max(verdict, (n, verdict)) AS leader, max(n) AS led, sum(n) AS judged FROM ({_O["bottleneck_verdicts"]}) GROUP BY capture_id),
ca AS (SELECT capture_id, share AS owner_share FROM ({_O["candidates"]}) WHERE place = 1),
pa AS (SELECT capture_id, solo / nullif(solo + shared, 0) AS solo_share, threads_working FROM ({_O["parallelism_threads"]})),
pl AS (SELECT capture_id, owned FROM ({_O["pattern_presence"]}) WHERE pattern = 'sync-load'),
kpt AS (SELECT capture_id, frame_id, tid, end_cycle - begin_cycle AS span, ms > {BUDGET!r} AS over, row_number() OVER (PARTITION BY capture_id, tid ORDER BY ms DESC, begin_cycle, frame_type, frame_id) AS k FROM fr WHERE ms > 0),
sp AS (SELECT capture_id, sum(span) AS span FROM kpt WHERE k <= 16 GROUP BY ALL),
nn AS (SELECT DISTINCT ON (node_id) * FROM nodes), nm AS (SELECT capture_id, spec, max(name) AS name FROM nn WHERE spec IS NOT NULL GROUP BY ALL),
st AS (SELECT capture_id, max(s) AS streaming_share FROM (SELECT kpt.capture_id, w.frame_id, sum(CASE WHEN {_WORDS("coalesce(name, '')", STREAMING)} THEN cycles ELSE 0 END) / sum(cycles) AS s FROM ({_O["frame_work_topn"]}) w JOIN kpt ON kpt.frame_id = w.frame_id AND k <= 16 AND over JOIN nm ON nm.capture_id = kpt.capture_id AND nm.spec = w.spec WHERE cycles > 0 GROUP BY ALL) GROUP BY ALL),
sl AS (SELECT capture_id, count(*) FILTER (WHERE spec IS NULL) AS specless FROM nn GROUP BY ALL),
gg AS (SELECT capture_id, count(*) AS gpu_frames, sum(unbalanced + truncated) AS odd FROM (SELECT DISTINCT ON (gpu_frame_id) * FROM gpu_frames) GROUP BY ALL),
et AS (SELECT capture_id, count(*) FILTER (WHERE fields IS NULL) AS broken, count(*) FILTER (WHERE logger = 'TaskTrace') AS task_types FROM (SELECT DISTINCT ON (capture_id, seq) * FROM event_types) GROUP BY ALL),
vs AS (SELECT capture_id, count(*) AS csv_values FROM csv_values GROUP BY ALL), ss AS (SELECT count(*) AS stats FROM csv_stats),
fx AS (SELECT c.capture_id, c.f, (SELECT count(*) FROM se WHERE se.capture_id = c.capture_id) AS frames, di.* EXCLUDE capture_id, cap_share, leader, led, judged, owner_share, solo_share, threads_working, owned / span AS load_share, streaming_share, specless, gpu_frames, coalesce(odd, 0) + coalesce(broken, 0) AS anomalies, task_types, csv_values, stats
  FROM c CROSS JOIN ss LEFT JOIN di USING (capture_id) LEFT JOIN cs USING (capture_id) LEFT JOIN bv USING (capture_id) LEFT JOIN ca USING (capture_id) LEFT JOIN pa USING (capture_id) LEFT JOIN sp USING (capture_id) LEFT JOIN pl USING (capture_id) LEFT JOIN st USING (capture_id) LEFT JOIN sl USING (capture_id) LEFT JOIN gg USING (capture_id) LEFT JOIN et USING (capture_id) LEFT JOIN vs USING (capture_id))
"""
)
_SQL_RULES = [
    ("budget-default", "'low'", "low", "certain", "true", repr(BUDGET)), ("no-frames", "'high'", "low", "unknown", "frames = 0", "0"), ("no-frequency", "'high'", "low", "certain", "frames > 0 AND coalesce(f, 0) = 0", "0"),
    ("frame-cap", "'high'", "low", "heuristic", "cap_share >= 0.25", "cap_share"), ("over-budget", "CASE WHEN over / n > 0.5 THEN 'high' ELSE 'medium' END", "medium", "certain", "over / n >= 0.05", "over / n"),
    ("tail-vs-mean", "'medium'", "medium", "certain", "over > 0 AND p50 > 0 AND p99 >= 2 * p50", "p99 / p50"), ("hitches", "'medium'", "medium", "certain", "hitches >= 1", "hitches"), ("thin-sample", "'low'", "low", "certain", "n < 100", "n"),
    ("bound-thread", "CASE WHEN led * 2 > judged THEN 'high' ELSE 'medium' END", "medium", "certain", "leader <> 'unexplained'", "led / judged"), ("bound-unexplained", "CASE WHEN led * 2 > judged THEN 'high' ELSE 'medium' END", "medium", "unknown", "leader = 'unexplained'", "led / judged"),
    ("one-timer", "'high'", "medium", "heuristic", "owner_share >= 0.25", "owner_share"), ("workers-idle", "'high'", "high", "certain", "threads_working >= 2 AND solo_share >= 0.8", "solo_share"), ("sync-load", "'medium'", "high", "heuristic", "load_share >= 0.05", "load_share"),
    ("async-loading", "'medium'", "high", "heuristic", "streaming_share >= 0.25", "streaming_share"), ("gpu-unknown", "'medium'", "low", "unknown", "coalesce(gpu_frames, 0) = 0", "0"), ("task-unknown", "'low'", "low", "unknown", "coalesce(task_types, 0) = 0", "0"),
    ("csv-no-values", "'low'", "medium", "certain", "coalesce(csv_values, 0) = 0 AND stats > 0", "stats"), ("attribution-gaps", "'low'", "medium", "certain", "specless > 0", "specless"), ("anomalies", "'medium'", "low", "certain", "anomalies > 0", "anomalies"),
]
_VECTOR = (
    _DISTRIBUTED
    + f""", nn AS (SELECT DISTINCT ON (node_id) * FROM nodes), wo AS (SELECT capture_id, count(spec) AS pairs, count(*) FILTER (WHERE spec IS NULL) / count(*) AS lost FROM nn GROUP BY ALL),
pa AS (SELECT capture_id, solo / nullif(solo + shared, 0) AS solo, threads_working FROM ({_O["parallelism_threads"]})), fi AS (SELECT capture_id, count(path) / count(*) AS located, count(DISTINCT path) AS files FROM ({src._TIMERS} SELECT capture_id, path FROM tm) GROUP BY ALL),
mv AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT capture_id, '{s}' AS section, '{s}.{k}' AS key, '{u}' AS unit, {low} AS lower_is_better, CAST({v} AS DOUBLE) AS value FROM {t}" for s, k, u, low, v, t in (
    ("frames", "count", "count", "false", "n", "di"), ("frames", "p50_ms", "ms", "true", "p50", "di"), ("frames", "p95_ms", "ms", "true", "p95", "di"), ("frames", "p99_ms", "ms", "true", "p99", "di"), ("frames", "max_ms", "ms", "true", "most", "di"), ("frames", "over", "count", "true", "over", "di"), ("frames", "hitches", "count", "true", "hitches", "di"),
    ("work", "pairs", "count", "false", "pairs", "wo"), ("work", "unattributed_share", "share", "true", "round(lost, 6)", "wo"), ("occupancy", "solo_share", "share", "true", "round(solo, 6)", "pa"), ("occupancy", "threads_working", "threads", "false", "threads_working", "pa"),
    ("sources", "located_share", "share", "false", "round(located, 6)", "fi"), ("sources", "files", "count", "false", "files", "fi")))}) WHERE value IS NOT NULL)"""
)
_STATES = f"""WITH rg AS (SELECT DISTINCT capture_id, channel FROM event_types JOIN (VALUES {", ".join(f"('{k}', '{c}')" for k, cs in REGISTRY.items() for c in cs)}) v(logger, channel) USING (logger)),
hd AS (SELECT capture_id, 'cpu' AS channel, count(DISTINCT spec) AS held FROM nodes GROUP BY ALL UNION ALL SELECT capture_id, 'frame', count(DISTINCT frame_id) FROM frames GROUP BY ALL
  UNION ALL SELECT capture_id, 'gpu', sum(n) FROM (SELECT capture_id, count(DISTINCT gpu_frame_id) AS n FROM gpu_frames GROUP BY ALL UNION ALL SELECT capture_id, count(DISTINCT span_id) FROM gpu_spans GROUP BY ALL) GROUP BY ALL UNION ALL SELECT capture_id, 'counters', count(DISTINCT value_id) FROM csv_values GROUP BY ALL),
jn AS (SELECT coalesce(rg.capture_id, hd.capture_id) AS capture_id, coalesce(rg.channel, hd.channel) AS channel, rg.capture_id IS NOT NULL AS enabled, held FROM rg FULL JOIN hd ON rg.capture_id = hd.capture_id AND rg.channel = hd.channel),
cs AS (SELECT capture_id, channel, enabled, CASE WHEN channel IN {MODELLED} THEN coalesce(held, 0) END AS held FROM jn),
sx AS (SELECT *, coalesce(held > 0, enabled) AS ready, CASE WHEN enabled AND held = 0 THEN 'recorded, but nothing is held' WHEN NOT enabled THEN 'not in the registry: its events are the evidence' ELSE '' END AS note FROM cs WHERE enabled OR held > 0)"""
ORACLES = {
    "advice_findings": _FACTS
    + ", al AS ("
    + " UNION ALL ".join(f"SELECT capture_id, '{r}' AS rule, {s} AS severity, '{e}' AS effort, '{c}' AS confidence, round(CAST({v} AS DOUBLE), 6) AS evidence FROM fx WHERE {w}" for r, s, e, c, w, v in _SQL_RULES)
    + ") SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY list_position(['high', 'medium', 'low'], severity), list_position(['certain', 'heuristic', 'unknown'], confidence), list_position(['low', 'medium', 'high'], effort), rule) AS place FROM al",
    "metric_vector": _VECTOR + " SELECT * FROM mv",
    "ab_compare": _VECTOR
    + f""", en AS (SELECT app, arg_min(capture_id, (started_at, capture_id)) AS a, arg_max(capture_id, (started_at, capture_id)) AS b FROM c GROUP BY app),
l AS (SELECT app, key, lower_is_better, value AS before FROM en JOIN mv ON mv.capture_id = en.a), r AS (SELECT app, key, lower_is_better, value AS after FROM en JOIN mv ON mv.capture_id = en.b),
j AS (SELECT coalesce(l.app, r.app) AS app, coalesce(l.key, r.key) AS key, coalesce(l.lower_is_better, r.lower_is_better) AS low, before, after, round((after - before) / nullif(before, 0), 6) AS ratio FROM l FULL JOIN r ON l.app = r.app AND l.key = r.key)
SELECT app, key, before, after, ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN CASE WHEN low THEN ratio ELSE -ratio END > {THRESHOLD} THEN 'worse' WHEN CASE WHEN low THEN ratio ELSE -ratio END < -{THRESHOLD} THEN 'better' ELSE 'same' END AS verdict FROM j""",
    "channel_states": _STATES + " SELECT * FROM sx",
    "coverage_verdicts": _STATES
    + f""", an AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {list(n)})" for a, n in ANALYSES)}) v(analysis, needs)), hv AS (SELECT capture_id, list(channel) AS have FROM sx WHERE ready GROUP BY ALL),
ms AS (SELECT capture_id, analysis, list_filter(needs, lambda x: NOT list_contains(coalesce(have, []), x)) AS m FROM (SELECT DISTINCT capture_id FROM captures) LEFT JOIN hv USING (capture_id) CROSS JOIN an)
SELECT capture_id, analysis, len(m) = 0 AS ready, array_to_string(list_sort(m), ',') AS missing, concat_ws(' and ', CASE WHEN len(list_filter(m, lambda x: x IN {MEMORY})) > 0 THEN 'Memory' END, CASE WHEN len(list_filter(m, lambda x: x NOT IN {MEMORY})) > 0 THEN 'Default' END) AS again FROM ms""",
}
