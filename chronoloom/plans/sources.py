"""Queries over the source files of timers: locations, files, modules and known patterns, weighed by kept work.

A timer's path is made of the words of its name, one layout of folders for each kind of last word: engine source,
engine plugin, project plugin, project. Kept work is the six largest timers of the sixteen longest frames of a thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import contains_any, located
from chronoloom.plans.captures import _FR, _N, _WORDS, BUDGET, LEAST_SPECS, PATTERNS, _kept_frames, frame_work_topn, once
from chronoloom.session import cut_lineage

_WORD = "^([A-Z][a-z]+)([A-Z][a-z]+)(Job|Async|Scope|)$"


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, spec, name, path: the timers of each capture; the greatest of a spec's names counts."""
    rows = once(spark, sf_dir, "nodes", "node_id").where("spec is not null").groupBy("capture_id", "spec").agg(F.max("name").alias("name"))
    verb, noun, last = (F.regexp_extract("name", _WORD, i) for i in (1, 2, 3))
    path = (
        F.when(last == "Job", F.concat(F.lit("D:\\Build\\Engine\\Source\\Runtime\\"), noun, F.lit("\\Private\\"), verb, F.lit(".cpp")))
        .when(last == "Async", F.concat(F.lit("/b/Engine/Plugins/Experimental/"), noun, F.lit("/Source/"), noun, F.lit("Core/"), verb, F.lit(".cpp")))
        .when(last == "Scope", F.concat(F.lit("D:\\Game\\Plugins\\"), noun, F.lit("\\Source\\"), verb, F.lit("Mod\\"), noun, F.lit(".cpp")))
        .otherwise(F.concat(F.lit("C:/Game/./Source/"), noun, F.lit("/"), verb, F.lit(".cpp")))
    )
    return rows.withColumn("path", F.when(F.col("name").rlike(_WORD), path))


def source_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each path of a timer says of its owner, and how many timers it has."""
    rows = timers(spark, sf_dir).where("path is not null").groupBy("path").agg(F.countDistinct("spec").alias("specs"))
    return located(rows, "path")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, frame_id, over, spec, cycles: the kept work, with whether its frame is over budget."""
    frames = _kept_frames(spark, sf_dir).select("capture_id", "frame_id", (F.col("ms") > BUDGET).alias("over"))
    return frame_work_topn(spark, sf_dir).select("frame_id", "spec", "cycles").where("cycles > 0").join(frames, "frame_id")


def _present(rows: DataFrame, group: list[str]) -> DataFrame:
    """capture_id, group..., owned, over_frames: the largest member of each frame, summed; the frames over budget among them."""
    most = rows.groupBy("capture_id", *group, "frame_id").agg(F.max("cycles").alias("_c"), F.max("over").alias("_o"))
    return most.groupBy("capture_id", *group).agg(F.sum("_c").alias("owned"), F.count_if("_o").alias("over_frames"))


def _rolled(spark: SparkSession, sf_dir: str, group: list[str]) -> DataFrame:
    """Timers with a location by group: specs, owned, over_frames and the largest of them."""
    known = cut_lineage(located(timers(spark, sf_dir).where("path is not null"), "path").select("capture_id", "spec", *group))
    kept = cut_lineage(_kept(spark, sf_dir))
    own = kept.groupBy("capture_id", "spec").agg(F.sum("cycles").alias("_own"))
    largest = F.min_by("spec", F.struct(-F.coalesce("_own", F.lit(0)), "spec")).alias("biggest")
    specs = known.join(own, ["capture_id", "spec"], "left").groupBy("capture_id", *group).agg(F.count(F.lit(1)).alias("specs"), largest)
    present = _present(kept.join(known.select("capture_id", "spec", *group), ["capture_id", "spec"]), group)
    return specs.join(present, ["capture_id", *group], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("owned", "over_frames")})


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each capture in order of what they own: (most owned, most timers, path)."""
    return _rolled(spark, sf_dir, ["relative"]).orderBy("capture_id", F.col("owned").desc(), F.col("specs").desc(), "relative")


def source_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of each capture and side in order of what they own: (most owned, most timers, label)."""
    return _rolled(spark, sf_dir, ["label", "side"]).drop("biggest").orderBy("capture_id", F.col("owned").desc(), F.col("specs").desc(), "label")


def pattern_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known patterns that two or more timers of a capture match: timers, kept work, frames over budget, the largest located one."""
    matched = F.explode(F.filter(F.array(*[F.when(contains_any(F.col("name"), words), F.lit(p)) for p, words in PATTERNS.items()]), lambda x: x.isNotNull()))
    rows = cut_lineage(timers(spark, sf_dir).where("name is not null").select("capture_id", "spec", F.col("path").isNotNull().alias("located"), matched.alias("pattern")))
    kept = cut_lineage(_kept(spark, sf_dir))
    own = kept.groupBy("capture_id", "spec").agg(F.sum("cycles").alias("_own"))
    largest = F.min_by("spec", F.when(F.col("located"), F.struct(-F.coalesce("_own", F.lit(0)), "spec"))).alias("biggest")
    specs = rows.join(own, ["capture_id", "spec"], "left").groupBy("capture_id", "pattern").agg(F.count(F.lit(1)).alias("specs"), largest).where(F.col("specs") >= LEAST_SPECS)
    present = _present(kept.join(rows.select("capture_id", "spec", "pattern"), ["capture_id", "spec"]), ["pattern"])
    return specs.join(present, ["capture_id", "pattern"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("owned", "over_frames")})


def timers_named(spark: SparkSession, sf_dir: str, text: str = "probe") -> DataFrame:
    """The timers whose name or path has a text in any case, with the default name of those without one."""
    rows = timers(spark, sf_dir).withColumn("shown", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("spec "), "spec")))
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return rows.where(has("shown") | has("path")).select("capture_id", "spec", "shown")


QUERIES = {f.__name__: f for f in (source_location, source_files, source_modules, pattern_presence, timers_named)}

_TIMERS = (
    _FR
    + ", "
    + _N
    + """,
ti AS (SELECT capture_id, spec, max(name) AS name FROM nd WHERE spec IS NOT NULL GROUP BY ALL),
tw AS (SELECT *, regexp_extract(name, '^([A-Z][a-z]+)([A-Z][a-z]+)(Job|Async|Scope|)$', 1) AS v, regexp_extract(name, '^([A-Z][a-z]+)([A-Z][a-z]+)(Job|Async|Scope|)$', 2) AS n, regexp_extract(name, '^([A-Z][a-z]+)([A-Z][a-z]+)(Job|Async|Scope|)$', 3) AS w FROM ti),
tm AS (SELECT capture_id, spec, name, CASE WHEN coalesce(v, '') = '' THEN NULL WHEN w = 'Job' THEN 'D:\\Build\\Engine\\Source\\Runtime\\' || n || '\\Private\\' || v || '.cpp' WHEN w = 'Async' THEN '/b/Engine/Plugins/Experimental/' || n || '/Source/' || n || 'Core/' || v || '.cpp'
  WHEN w = 'Scope' THEN 'D:\\Game\\Plugins\\' || n || '\\Source\\' || v || 'Mod\\' || n || '.cpp' ELSE 'C:/Game/./Source/' || n || '/' || v || '.cpp' END AS path,
  CASE w WHEN 'Job' THEN 'engine-source' WHEN 'Async' THEN 'engine-plugin' WHEN 'Scope' THEN 'project-plugin' ELSE 'project' END AS kind,
  CASE w WHEN 'Job' THEN 'Runtime' WHEN 'Async' THEN 'Experimental' WHEN 'Scope' THEN n ELSE '' END AS grp, CASE w WHEN 'Job' THEN n WHEN 'Async' THEN n || 'Core' WHEN 'Scope' THEN v || 'Mod' ELSE n END AS module,
  CASE w WHEN 'Job' THEN 'Source/Runtime/' || n || '/Private/' || v || '.cpp' WHEN 'Async' THEN 'Plugins/Experimental/' || n || '/Source/' || n || 'Core/' || v || '.cpp' WHEN 'Scope' THEN 'Plugins/' || n || '/Source/' || v || 'Mod/' || n || '.cpp' ELSE 'Game/Source/' || n || '/' || v || '.cpp' END AS relative,
  CASE w WHEN 'Scope' THEN n ELSE v END || '.cpp' AS basename FROM tw),
lo AS (SELECT *, CASE WHEN grp <> '' THEN grp || '/' || module ELSE module END AS label, CASE WHEN kind LIKE 'engine%' THEN 'engine' ELSE 'game' END AS side FROM tm WHERE path IS NOT NULL),
kp AS (SELECT capture_id, frame_id, over FROM (SELECT capture_id, frame_id, ms > {budget} AS over, row_number() OVER (PARTITION BY capture_id, tid ORDER BY ms DESC, begin_cycle, frame_type, frame_id) AS k FROM fr WHERE ms > 0) WHERE k <= 16),
cy AS (SELECT frame_id, spec, sum(inclusive) AS cycles FROM nd WHERE spec IS NOT NULL AND frame_id IN (SELECT frame_id FROM kp) GROUP BY ALL),
kw AS (SELECT kp.capture_id, kp.frame_id, over, spec, cycles FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cycles DESC, spec) AS place FROM cy WHERE cycles IS NOT NULL) JOIN kp USING (frame_id) WHERE place <= 6 AND cycles > 0),
ow AS (SELECT capture_id, spec, sum(cycles) AS own FROM kw GROUP BY ALL)
""".replace("{budget}", repr(BUDGET))
)


def _rollup_sql(group: str, of: str, pick: str) -> str:
    return f"""SELECT s.*, coalesce(owned, 0) AS owned, coalesce(over_frames, 0) AS over_frames FROM (SELECT capture_id, {group}, count(*) AS specs{pick} FROM {of} LEFT JOIN ow USING (capture_id, spec) GROUP BY ALL) s
  LEFT JOIN (SELECT capture_id, {group}, sum(c) AS owned, count(*) FILTER (WHERE o) AS over_frames FROM (SELECT capture_id, {group}, frame_id, max(cycles) AS c, bool_or(over) AS o FROM kw JOIN {of} USING (capture_id, spec) GROUP BY ALL) GROUP BY ALL) p USING (capture_id, {group})"""


ORACLES = {
    "source_location": _TIMERS + "SELECT path, count(DISTINCT spec) AS specs, any_value(basename) AS basename, any_value(side) AS side, any_value(kind) AS kind, any_value(grp) AS \"group\", any_value(module) AS module, any_value(relative) AS relative, any_value(label) AS label FROM lo GROUP BY path",
    "source_files": _TIMERS + _rollup_sql("relative", "lo", ", arg_min(spec, (-coalesce(own, 0), spec)) AS biggest"),
    "source_modules": _TIMERS + _rollup_sql("label, side", "lo", ""),
    "pattern_presence": _TIMERS
    + ", pt AS ("
    + " UNION ALL ".join(f"SELECT capture_id, spec, path IS NOT NULL AS located, '{p}' AS pattern FROM tm WHERE name IS NOT NULL AND {_WORDS('name', w)}" for p, w in PATTERNS.items())
    + ") SELECT * FROM ("
    + _rollup_sql("pattern", "pt", ", arg_min(spec, (-coalesce(own, 0), spec)) FILTER (WHERE located) AS biggest")
    + f") WHERE specs >= {LEAST_SPECS}",
    "timers_named": _TIMERS + "SELECT capture_id, spec, coalesce(nullif(name, ''), 'spec ' || spec) AS shown FROM tm WHERE contains(lower(coalesce(nullif(name, ''), 'spec ' || spec)), 'probe') OR contains(lower(coalesce(path, '')), 'probe')",
}
