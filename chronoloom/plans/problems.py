"""The queries of the general problems (schema drift, spikes, intervals), over the tables of a data folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.interval_map import periods_and_gaps
from chronoloom.operators.records import latest_delivery, micros
from chronoloom.operators.schema_drift import changes, consistent_fields, declarations, read_union
from chronoloom.operators.spikes import implausible
from chronoloom.session import table, written


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The declaration of each full_name that counts in each capture, with the capture's app and start; and the lists of fields."""
    named = F.coalesce("full_name", F.concat("logger", F.lit("."), "name"))
    types = table(spark, sf_dir, "event_types").select("capture_id", named.alias("full_name"), "seq", "fields", "ingested_at")
    captures = latest_delivery(table(spark, sf_dir, "captures"), ["capture_id"], "ingested_at", ["app", "started_at"])
    declared, lists = declarations(types, ["capture_id"], "full_name", "seq", "ingested_at")
    return written(declared.join(captures, "capture_id")), written(lists)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a declared field or full_name from one capture of an app to the next."""
    found = changes(*_declared(spark, sf_dir), "app", "full_name", "capture_id", ["started_at", "capture_id"])
    return found.select("capture_id", "full_name", "field_name", "change")


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared field with the type that holds all its types in the app."""
    fields = consistent_fields(*_declared(spark, sf_dir), "app", "full_name", "capture_id")
    return fields.withColumnRenamed("name", "field_name").withColumn("offset", F.col("offset").cast("long"))


def p1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of event_types as one table, each cast to the union of their schemas."""
    at = Path(sf_dir, "event_types.parquet")
    files = sorted(str(f.absolute()) for f in at.glob("*.parquet")) if at.is_dir() else [str(at.absolute())]
    return read_union(spark, files)[0]


#: Least and greatest value of each unit of csv_stats, and whether it counts whole things.
UNITS = {
    "ms": (0.0, 1e6, False),
    "count": (0.0, 2.0**31 - 1, True),
    "mb": (0.0, 1e7, False),
    "percent": (0.0, 100.0, False),
    "celsius": (-273.15, 1000.0, False),
}


def _impossible(value: Column, unit: Column) -> Column:
    """Whether a unit rules a value out; an unknown unit rules out none."""
    ruled = F.lit(False)
    for name, (low, high, whole) in UNITS.items():
        outside = (value < low) | (value > high)
        ruled = F.when(unit == name, outside | (value != F.rint(value)) if whole else outside).otherwise(ruled)
    return ruled


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of all three tables with source, order, id, value and impossible, as they were delivered."""
    captures = latest_delivery(table(spark, sf_dir, "captures"), ["capture_id"], "ingested_at", ["app", "started_at", "hitches", "frame_count"])
    hitches = captures.select(
        F.concat(F.lit("captures/"), "app").alias("source"),
        micros(F.col("started_at")).alias("order"),
        F.col("capture_id").alias("id"),
        F.col("hitches").cast("double").alias("value"),
        ((F.col("hitches") < 0) | (F.col("hitches") > F.col("frame_count"))).alias("impossible"),
    )
    frames = table(spark, sf_dir, "frames").select(
        F.concat_ws("/", F.lit("frames"), "capture_id", "tid").alias("source"),
        F.col("begin_cycle").alias("order"),
        F.col("frame_id").alias("id"),
        F.col("milliseconds").alias("value"),
        # a frame takes some time
        ((F.col("milliseconds") <= 0) | (F.col("milliseconds") > UNITS["ms"][1])).alias("impossible"),
    )
    units = table(spark, sf_dir, "csv_stats").groupBy("stat").agg(F.max("unit").alias("unit"))
    values = table(spark, sf_dir, "csv_values").join(units, "stat", "left")
    stats = values.select(
        F.concat_ws("/", F.lit("csv_values"), "capture_id", "stat").alias("source"),
        F.col("seq").alias("order"),
        F.col("value_id").alias("id"),
        F.col("value"),
        _impossible(F.col("value"), F.col("unit")).alias("impossible"),
    )
    return hitches.unionByName(frames).unionByName(stats)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes, stuck runs and impossible readings of hitches, frame times and stat values."""
    found = implausible(_readings(spark, sf_dir))
    return found.select(F.substring_index("source", "/", 1).alias("source_table"), F.col("id").alias("row_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of GPU work per capture, queue and kind."""
    spans = table(spark, sf_dir, "gpu_spans").where("begin_us > 0")
    return periods_and_gaps(spans, ["capture_id", "queue", "kind"], "begin_us", "end_us")


QUERIES = {f.__name__: f for f in (p1_found, p1_fields, p1_union, p2_found, p4_found)}

_DECLARED = """
WITH c AS (SELECT capture_id, arg_max(app, ingested_at) AS app, arg_max(started_at, ingested_at) AS started_at FROM captures GROUP BY capture_id),
t AS (SELECT capture_id, coalesce(full_name, logger || '.' || name) AS full_name, seq, ingested_at, fields FROM event_types WHERE fields IS NOT NULL),
d AS (SELECT capture_id, full_name, fields, app, started_at FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id, full_name ORDER BY seq DESC, ingested_at DESC) AS k FROM t) JOIN c USING (capture_id)
  WHERE k = 1 AND full_name IS NOT NULL)
"""

# the least type that holds two, by width and kind, said without the operator's table
_RANKS = """
k AS (SELECT app, full_name, x.name AS field_name, list_sort(list(DISTINCT x.type_name)) AS kinds FROM (SELECT app, full_name, unnest(fields) AS x FROM d) GROUP BY ALL),
b AS (SELECT *, len(kinds) AS m, list_bool_and(list_transform(kinds, lambda t: t IN ('bool', 'u8', 'u16', 'u32', 'u64', 'i8', 'i16', 'i32', 'i64'))) AS whole,
  list_bool_and(list_transform(kinds, lambda t: t IN ('bool', 'u8', 'u16', 'u32', 'u64', 'i8', 'i16', 'i32', 'i64', 'f32', 'f64'))) AS number,
  list_max(list_transform(kinds, lambda t: CASE WHEN t LIKE 'u%' THEN CAST(substr(t, 2) AS INT) WHEN t = 'bool' THEN 1 ELSE 0 END)) AS un,
  list_max(list_transform(kinds, lambda t: CASE WHEN t LIKE 'i%' THEN CAST(substr(t, 2) AS INT) ELSE 0 END)) AS si,
  list_max(list_transform(kinds, lambda t: CASE WHEN t LIKE 'f%' THEN CAST(substr(t, 2) AS INT) ELSE 0 END)) AS re FROM k),
w AS (SELECT *, CASE WHEN si = 0 THEN un WHEN un = 64 THEN 128 WHEN un < si THEN si ELSE 2 * un END AS bits FROM b),
un AS (SELECT app, full_name, field_name, CASE WHEN m = 1 THEN kinds[1]
  WHEN whole AND si = 0 THEN 'u' || un WHEN whole THEN 'i' || CASE WHEN un = 1 THEN si ELSE bits END
  WHEN number AND re > 0 AND (un >= 32 OR si > 32) THEN 'WideString'
  WHEN number AND (re = 64 OR un >= 16 OR si > 16) THEN 'f64' WHEN number THEN 'f32' ELSE 'WideString' END AS union_type FROM w)
"""

ORACLES = {
    "p1_fields": _DECLARED
    + ","
    + _RANKS
    + """SELECT d.app, d.capture_id, d.full_name, x.name AS field_name, CAST(x."offset" AS BIGINT) AS "offset", x.type_name AS type_name, union_type
  FROM (SELECT app, capture_id, full_name, unnest(fields) AS x FROM d) d JOIN un ON un.app = d.app AND un.full_name = d.full_name AND un.field_name = d.x.name""",
    "p1_found": _DECLARED
    + """,
o AS (SELECT *, row_number() OVER (PARTITION BY app, full_name ORDER BY started_at, capture_id) AS n FROM d),
f AS (SELECT app, full_name, n, capture_id, x.name AS fname, x."offset" AS off, x.type_name AS ty, x.index AS ix FROM (SELECT *, unnest(fields) AS x FROM o)),
come AS (SELECT b.*, row_number() OVER (PARTITION BY b.app, b.full_name, b.n, b.off, b.ty ORDER BY b.ix) AS r FROM f b
  WHERE b.n > 1 AND NOT EXISTS (SELECT 1 FROM f a WHERE a.app = b.app AND a.full_name = b.full_name AND a.n = b.n - 1 AND a.fname = b.fname)),
gone AS (SELECT o.app, o.full_name, o.n, o.capture_id, a.fname, a.off, a.ty,
    row_number() OVER (PARTITION BY a.app, a.full_name, o.n, a.off, a.ty ORDER BY a.ix) AS r
  FROM f a JOIN o ON o.app = a.app AND o.full_name = a.full_name AND o.n = a.n + 1
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.app = a.app AND b.full_name = a.full_name AND b.n = a.n + 1 AND b.fname = a.fname)),
kept AS (SELECT b.capture_id, b.full_name, b.fname, a.off AS aoff, b.off AS boff, a.ty AS aty, b.ty AS bty
  FROM f a JOIN f b ON a.app = b.app AND a.full_name = b.full_name AND b.n = a.n + 1 AND a.fname = b.fname),
lives AS (SELECT app, full_name, min(started_at) AS first, max(started_at) AS last, arg_min(capture_id, started_at) AS capture_id,
  arg_min(list_transform(fields, lambda x: (x.name, x."offset", x.type_name)), started_at) AS began,
  arg_max(list_transform(fields, lambda x: (x.name, x."offset", x.type_name)), started_at) AS ended FROM d GROUP BY app, full_name)
SELECT c.capture_id, c.full_name, c.fname AS field_name, CASE WHEN g.fname IS NULL THEN 'added' ELSE 'renamed' END AS change
  FROM come c LEFT JOIN gone g ON c.app = g.app AND c.full_name = g.full_name AND c.n = g.n AND c.off = g.off AND c.ty = g.ty AND c.r = g.r
UNION ALL SELECT g.capture_id, g.full_name, g.fname, 'removed' FROM gone g
  ANTI JOIN come c ON c.app = g.app AND c.full_name = g.full_name AND c.n = g.n AND c.off = g.off AND c.ty = g.ty AND c.r = g.r
UNION ALL SELECT capture_id, full_name, fname, 'retyped' FROM kept WHERE aty <> bty
UNION ALL SELECT capture_id, full_name, fname, 'moved' FROM kept WHERE aoff <> boff
UNION ALL SELECT b.capture_id, b.full_name, '', 'type_renamed' FROM lives b
  WHERE EXISTS (SELECT 1 FROM lives a WHERE a.app = b.app AND a.full_name <> b.full_name AND a.ended = b.began AND a.last < b.first)
""",
    "p4_found": """
WITH s AS (SELECT DISTINCT capture_id, queue, kind, begin_us, end_us FROM gpu_spans WHERE begin_us > 0 AND end_us > begin_us),
m AS (SELECT *, max(end_us) OVER (PARTITION BY capture_id, queue, kind ORDER BY begin_us, end_us
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
i AS (SELECT *, sum(CASE WHEN begin_us <= far THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id, queue, kind
        ORDER BY begin_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT capture_id, queue, kind, island, min(begin_us) AS begin_us, max(end_us) AS end_us FROM i GROUP BY ALL),
g AS (SELECT capture_id, queue, kind, end_us AS begin_us, lead(begin_us) OVER (PARTITION BY capture_id, queue, kind ORDER BY begin_us) AS end_us FROM p)
SELECT capture_id, queue, kind, 'period' AS what, begin_us, end_us FROM p
UNION ALL SELECT capture_id, queue, kind, 'gap', begin_us, end_us FROM g WHERE end_us IS NOT NULL
""",
}
