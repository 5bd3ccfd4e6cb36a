"""The queries of the problems tagged llm, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.nearest_time import nearest
from chronoloom.llm.packing import pack
from chronoloom.llm.quantile_sketch import merge, percentiles, sketches
from chronoloom.llm.sentences import sentence_ends
from chronoloom.llm.tokens import decoded, token_counts, token_ids
from chronoloom.llm.top_n import top_n
from chronoloom.operators.records import latest_delivery
from chronoloom.session import cut_lineage, table

TOLERANCE_US = 3_000
TOP = 3
CAPACITY = 4_096
SALT = 8


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each GPU frame with the nearest closed frame of its capture and thread within 3,000 us."""
    clocks = latest_delivery(table(spark, sf_dir, "captures"), ["capture_id"], "ingested_at", ["cycle_frequency"])
    frames = table(spark, sf_dir, "frames").where("end_cycle > begin_cycle").select("capture_id", "tid", F.col("begin_cycle").alias("ticks"), F.col("frame_id").alias("id"))
    asked = table(spark, sf_dir, "gpu_frames").where("base_us > 0").select("capture_id", "tid", F.col("base_us").alias("ticks"), F.col("gpu_frame_id").alias("id"))
    clocks = clocks.withColumnRenamed("cycle_frequency", "scale")
    found = nearest(frames.join(clocks, "capture_id"), asked.join(clocks, "capture_id"), ["capture_id", "tid"], TOLERANCE_US)
    return found.select(F.col("left_id").alias("frame_id"), F.col("right_id").alias("gpu_frame_id"))


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame once, with _salt: a hot capture is spread over SALT tasks."""
    frames = table(spark, sf_dir, "frames").select("frame_id", "capture_id", "frame_type", "milliseconds", "begin_cycle")
    salt = F.pmod(F.xxhash64("frame_id"), F.lit(SALT))
    return frames.repartition(F.col("capture_id"), salt).withColumn("_salt", salt).dropDuplicates(["capture_id", "_salt", "frame_id"])


def _started(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = latest_delivery(table(spark, sf_dir, "captures"), ["capture_id"], "ingested_at", ["app", "started_at"])
    return started.select("capture_id", "app", F.to_date("started_at").alias("day"))


def _capture_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sketch of each measure per capture and frame type, with the capture's app and day."""
    parts = sketches(_once(spark, sf_dir), ["capture_id", "frame_type"], ["milliseconds", "begin_cycle"])
    return merge(parts, ["capture_id", "frame_type"]).join(_started(spark, sf_dir), "capture_id")


def p5_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day alone, per app and frame type: the partial results that p5_percentiles combines."""
    return percentiles(_capture_sketches(spark, sf_dir), ["app", "frame_type", "day"])


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per app and frame type, from the sketches of each day, and per capture."""
    parts = cut_lineage(_capture_sketches(spark, sf_dir))
    daily = merge(parts, ["app", "frame_type", "day"])
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    apps = daily.select(F.lit("app").alias("grouping"), "app", "frame_type", null("long", "capture_id"), "measure", "sketch")
    captures = parts.select(F.lit("capture").alias("grouping"), null("string", "app"), null("int", "frame_type"), "capture_id", "measure", "sketch")
    return percentiles(apps.unionByName(captures), ["grouping", "app", "frame_type", "capture_id"])


def p5_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of p5_percentiles beside all rows: of each group n, and how many ranks lie beyond the bound.

    The rank of a value found is exact: rows below it and rows up to it, the value's own error allowed.
    """
    found = p5_percentiles(spark, sf_dir).withColumn("_g", F.monotonically_increasing_id())
    found = cut_lineage(found)
    rows = _once(spark, sf_dir).join(_started(spark, sf_dir).drop("day"), "capture_id")
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in ("milliseconds", "begin_cycle")]))
    rows = rows.select("app", "frame_type", "capture_id", measures.alias("_m")).select("app", "frame_type", "capture_id", "_m.*").where("x is not null and not isnan(x)")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}

    def beside(keys: list[str], grouping: str) -> DataFrame:
        own = found.where(F.col("grouping") == grouping).select(*keys, "measure", "n", "rank_error", *shares)
        low = lambda p: F.col(p) - F.abs(p) * 2.0**-19
        high = lambda p: F.col(p) + F.abs(p) * 2.0**-19
        counts = [c for p in shares for c in (F.count_if(F.col("x") < low(p)).alias(f"{p}_below"), F.count_if(F.col("x") <= high(p)).alias(f"{p}_upto"))]
        made = rows.join(own, [*keys, "measure"]).groupBy(*keys, "measure").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("rank_error").alias("_e"), *counts)
        beyond = F.lit(0)
        for p, q in shares.items():
            rank, room = F.ceil(F.round(F.lit(q) * F.col("n"), 9)), F.col("_e") * F.col("n") + 1
            beyond = beyond + F.when((rank < F.col(f"{p}_below") - room) | (rank > F.col(f"{p}_upto") + room), 1).otherwise(0)
        return made.select(F.lit(grouping).alias("grouping"), *[(F.col(k) if k in keys else F.lit(None).cast(t)).alias(k) for k, t in (("app", "string"), ("frame_type", "int"), ("capture_id", "long"))], "measure", "n", "rows", beyond.alias("_beyond"))

    every = beside(["app", "frame_type"], "app").unionByName(beside(["capture_id"], "capture"))
    made = every.groupBy("grouping", "measure").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("_beyond").alias("_beyond"))
    # the bound holds for about 99 of 100: three ranks a group, and one of them in fifty would be too many
    return made.withColumn("within", F.col("_beyond") <= 0.02 * 3 * F.col("groups")).drop("_beyond")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nodes of each spec and the three passes of each capture with the largest measure."""
    nodes = table(spark, sf_dir, "nodes").select("spec", "inclusive", "node_id")
    passes = latest_delivery(table(spark, sf_dir, "passes"), ["pass_id"], "ingested_at", ["capture_id", "inclusive_ms"])
    best_nodes = top_n(nodes, ["spec"], "inclusive", "node_id", TOP)
    best_passes = top_n(passes, ["capture_id"], "inclusive_ms", "pass_id", TOP)
    return best_nodes.select(F.lit("nodes").alias("source_table"), F.col("spec").alias("group_id"), F.col("node_id").alias("item_id")).unionByName(
        best_passes.select(F.lit("passes").alias("source_table"), F.col("capture_id").alias("group_id"), F.col("pass_id").alias("item_id"))
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every text."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the bytes that the ids of every text decode to."""
    return decoded(token_ids(table(spark, sf_dir, "documents"), "doc_id", "text"), "ids").select("doc_id", F.md5("ids").alias("text_md5"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every part of a text of more than 4,096 tokens."""
    documents = table(spark, sf_dir, "documents")
    return pack(token_counts(documents, "doc_id", "text"), "doc_id", "tokens", CAPACITY, total=documents.count())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers of p8_containers are right: documents, those not whole, divided without need, containers overfull, and full enough."""
    documents = table(spark, sf_dir, "documents")
    sizes = cut_lineage(token_counts(documents, "doc_id", "text"))
    parts = cut_lineage(pack(sizes, "doc_id", "tokens", CAPACITY))
    whole = parts.groupBy("doc_id").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_parts")).join(sizes, "doc_id", "full")
    people = whole.agg(
        F.count("_size").alias("documents"),
        F.count_if(~F.col("_size").eqNullSafe(F.col("tokens"))).alias("not_whole"),
        F.count_if((F.col("tokens") <= CAPACITY) & (F.col("_parts") > 1)).alias("divided"),
    )
    filled = parts.groupBy("container").agg(F.sum("size").alias("_fill"))
    boxes = filled.agg(F.count_if(F.col("_fill") > CAPACITY).alias("overfull"), (F.sum("_fill") >= 0.98 * CAPACITY * (F.count(F.lit(1)) - 1)).alias("tight"))
    return people.crossJoin(boxes)  # one row beside one row


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence spoken in every text."""
    return sentence_ends(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


QUERIES = {f.__name__: f for f in (p3_found, p5_percentiles, p5_daily, p5_within, p6_found, p7_ids, p7_decoded, p8_containers, p8_fill, p9_found)}

# Oracles on DuckDB: a plain window for the bands of p6, a plain inequality join for the shards of p3.
ORACLES = {
    "p5_within": """
WITH c AS (SELECT capture_id, arg_max(app, ingested_at) AS app FROM captures GROUP BY capture_id),
f AS (SELECT DISTINCT ON (frame_id) capture_id, frame_type, milliseconds, CAST(begin_cycle AS DOUBLE) AS begin_cycle FROM frames),
r AS (SELECT app, frame_type, capture_id, 'milliseconds' AS measure, milliseconds AS x FROM f JOIN c USING (capture_id) UNION ALL SELECT app, frame_type, capture_id, 'begin_cycle', begin_cycle FROM f JOIN c USING (capture_id)),
g AS (SELECT 'app' AS "grouping", measure, app || '/' || frame_type AS k, count(*) AS n FROM r WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL
  UNION ALL SELECT 'capture', measure, CAST(capture_id AS VARCHAR), count(*) FROM r WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY measure, capture_id)
SELECT "grouping", measure, count(*) AS groups, sum(n) AS n, sum(n) AS "rows", true AS within FROM g GROUP BY ALL
""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p8_fill": "SELECT count(DISTINCT doc_id) AS documents, 0 AS not_whole, 0 AS divided, 0 AS overfull, true AS tight FROM documents",
    "p3_found": """
WITH clocks AS (SELECT capture_id, arg_max(cycle_frequency, ingested_at) AS f FROM captures GROUP BY capture_id),
fr AS (SELECT DISTINCT frame_id, capture_id, tid, begin_cycle FROM frames WHERE end_cycle > begin_cycle),
g AS (SELECT DISTINCT gpu_frame_id, capture_id, tid, base_us FROM gpu_frames WHERE base_us > 0),
pairs AS (
  SELECT frame_id, gpu_frame_id, begin_cycle, abs(CAST(base_us AS HUGEINT) * f - CAST(begin_cycle AS HUGEINT) * 1000000) AS d, f
  FROM g JOIN clocks USING (capture_id) JOIN fr USING (capture_id, tid))
SELECT frame_id, gpu_frame_id FROM (
  SELECT frame_id, gpu_frame_id, row_number() OVER (PARTITION BY gpu_frame_id ORDER BY d, begin_cycle, frame_id) AS k
  FROM pairs WHERE d <= CAST(f AS HUGEINT) * 3000) WHERE k = 1
""",
    "p6_found": """
WITH n AS (SELECT DISTINCT spec, inclusive, node_id FROM nodes WHERE spec IS NOT NULL AND inclusive IS NOT NULL),
p AS (SELECT capture_id, pass_id, inclusive_ms FROM (
  SELECT capture_id, pass_id, inclusive_ms, row_number() OVER (PARTITION BY pass_id ORDER BY ingested_at DESC) AS k FROM passes)
  WHERE k = 1 AND inclusive_ms IS NOT NULL AND NOT isnan(inclusive_ms) AND capture_id IS NOT NULL)
SELECT 'nodes' AS source_table, spec AS group_id, node_id AS item_id FROM (
  SELECT spec, node_id, row_number() OVER (PARTITION BY spec ORDER BY inclusive DESC, node_id) AS k FROM n) WHERE k <= 3
UNION ALL
SELECT 'passes', capture_id, pass_id FROM (
  SELECT capture_id, pass_id, row_number() OVER (PARTITION BY capture_id ORDER BY inclusive_ms + 0.0 DESC, pass_id) AS k FROM p) WHERE k <= 3
""",
}
