"""Scalar rules as column expressions, so that Catalyst sees them. The word lists are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that make a scope a wait or a lock, and marks of thread roles
LOCK_WORDS = ("Lock", "Locks", "Locked", "Unlock", "Mutex", "Critical", "Semaphore")
ROLES = (("gamethread", "game"), ("renderthread", "render"), ("rhi", "rhi"))
EXECUTION = {0: "RHI", 1: "Game", 2: "Render", 255: "any"}
LOCAL_QUEUE, TASK_PRIORITY, THREAD_PRIORITY, THREAD_HIGH, THREAD_BACKGROUND = 0x100, 0x200, 0xC00, 0x400, 0x800
EVENT_FLAGS = ("Important", "MaybeHasAux", "NoSync", "Definition")
CAP_PERIODS = (1 / 60, 1 / 30, 1 / 120, 1 / 90)
CAP_TOLERANCE = 0.05


def scope_kind(name: Column) -> Column:
    """'wait' where the name has 'wait' in any case, else 'lock' where one of its camel-case words is one, else 'work'."""
    pattern = f"({'|'.join(LOCK_WORDS)})([^a-z]|$)"
    return F.when(F.contains(F.lower(name), F.lit("wait")), "wait").when(name.rlike(pattern), "lock").otherwise("work")


def role(name: Column) -> Column:
    """The first role whose mark the thread's name has; null without one."""
    found = F.lit(None).cast("string")
    for mark, label in reversed(ROLES):
        found = F.when(F.contains(F.lower(name), F.lit(mark)), label).otherwise(found)
    return found


def contains_any(name: Column, fragments: list[str] | tuple[str, ...]) -> Column:
    """Whether the lower-case name has any of the fragments."""
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda w: F.contains(F.lower(name), w))


def execution(code: Column) -> Column:
    """What a packed thread code names: its low byte."""
    low = code.bitwiseAND(F.lit(255))
    found = F.concat(F.lit("thread "), low.cast("string"))
    for value, label in EXECUTION.items():
        found = F.when(low == value, label).otherwise(found)
    return found


def execution_parts(code: Column) -> Column:
    """What a packed thread code says: the thread, local (whether it has a queue of its own), urgent (the task's priority) and the thread's priority."""
    priority = F.when(code.bitwiseAND(F.lit(THREAD_PRIORITY)) == THREAD_HIGH, "high").when(code.bitwiseAND(F.lit(THREAD_PRIORITY)) == THREAD_BACKGROUND, "background").otherwise("normal")
    set_ = lambda bit: code.bitwiseAND(F.lit(bit)) != 0
    return F.struct(execution(code).alias("thread"), set_(LOCAL_QUEUE).alias("local"), set_(TASK_PRIORITY).alias("urgent"), priority.alias("priority"))


def queue_parts(code: Column) -> tuple[Column, Column, Column]:
    """gpu, index and type of a packed queue id."""
    return F.shiftright(code, 8).bitwiseAND(F.lit(255)), F.shiftright(code, 16).bitwiseAND(F.lit(255)), code.bitwiseAND(F.lit(255))


def flag_names(flags: Column) -> Column:
    """Names of the set bits, joined by '+'; 'none' where no bit is set."""
    bits = [F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(EVENT_FLAGS)]
    found = F.filter(F.array(*bits), lambda x: x.isNotNull())
    return F.when(flags.isNotNull(), F.when(F.size(found) > 0, F.array_join(found, "+")).otherwise("none"))


def at_cap(seconds: Column) -> Column:
    """Whether a duration lies within 5% of a period from a whole multiple of a display period."""
    near = F.lit(False)
    for period in CAP_PERIODS:
        times = F.bround(seconds / F.lit(period))
        near = near | ((times >= 1) & (F.abs(seconds - times * F.lit(period)) <= F.lit(CAP_TOLERANCE * period)))
    return near


def path_segments(path: Column) -> Column:
    """Segments of a path with either slash, without white space around them; drive letters, '.' and empty ones dropped."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & (s != ".") & ~s.rlike("^[A-Za-z]:$"))


def located(df: DataFrame, path: str) -> DataFrame:
    """df with basename, side, kind, group, module, relative and label: what a source path says of its owner; null for no path.

    A first segment Engine before Source or Plugins is the root of an engine's source or plugin; else the first Plugins
    makes a project's plugin, else a Source a project's module, else nothing is known. The module is the segment after the
    Source below the root; an engine's source has its group before the module. Each path is taken apart once, however many
    rows have it.
    """
    position = lambda values, word: F.array_position(values, F.lit(word)).cast("int")
    # step by step: an expression that names its parts again and again would compute them again and again
    rows = df.select(F.col(path).alias("_path")).where("_path is not null").distinct().withColumn("_w", path_segments(F.col("_path"))).where("size(_w) > 0")
    rows = rows.withColumn("_low", F.transform("_w", F.lower)).withColumns({"_engine": position(F.col("_low"), "engine"), "_plugins": position(F.col("_low"), "plugins"), "_source": position(F.col("_low"), "source")})
    rows = rows.withColumn("_next", F.when(F.col("_engine") > 0, F.try_element_at("_low", F.col("_engine") + 1)))
    kind = F.when(F.col("_next") == "source", "engine-source").when(F.col("_next") == "plugins", "engine-plugin").when(F.col("_plugins") > 0, "project-plugin").when(F.col("_source") > 0, "project").otherwise("unknown")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("_root", F.when(F.col("kind").startswith("engine"), F.col("_engine")).when(F.col("kind") == "project-plugin", F.col("_plugins")).otherwise(0))
    rows = rows.withColumn("_below", position(F.slice("_low", F.col("_root") + 1, F.size("_low")), "source"))
    rows = rows.withColumn("_at", F.when((F.col("_below") > 0) & (F.col("kind") != "unknown"), F.col("_root") + F.col("_below")).otherwise(0))
    rows = rows.withColumn("_after", F.when(F.col("_at") > 0, F.slice("_w", F.col("_at") + 1, F.size("_w"))).otherwise(F.array().cast("array<string>")))
    part = lambda values, at: F.coalesce(F.try_element_at(values, at), F.lit(""))
    grouped = (F.col("kind") == "engine-source") & (F.size("_after") >= 2)
    group = (
        F.when(grouped, part(F.col("_after"), F.lit(1)))
        .when(F.col("kind") == "engine-plugin", part(F.col("_w"), F.col("_plugins") + 1))
        .when((F.col("kind") == "project-plugin") & (F.col("_at") > F.col("_root") + 1), F.array_join(F.slice("_w", F.col("_root") + 1, F.greatest(F.lit(0), F.col("_at") - F.col("_root") - 1)), "/"))
        .otherwise("")
    )
    rows = rows.withColumns({"group": group, "module": part(F.col("_after"), F.when(grouped, 2).otherwise(1))})
    start = F.when(F.col("kind") == "project-plugin", F.col("_root")).otherwise(F.col("_root") + 1)
    label = F.when((F.col("group") != "") & (F.col("module") != ""), F.concat("group", F.lit("/"), "module")).otherwise(F.coalesce(F.nullif("module", F.lit("")), F.nullif("group", F.lit("")), F.lit("(unknown)")))
    side = F.when(F.col("kind").startswith("engine"), "engine").when(F.col("kind").startswith("project"), "game").otherwise("unknown")
    made = rows.select("_path", F.element_at("_w", -1).alias("basename"), side.alias("side"), "kind", "group", "module", F.array_join(F.slice("_w", start, F.size("_w")), "/").alias("relative"), label.alias("label"))
    return df.join(made, F.col(path) == F.col("_path"), "left").drop("_path")


def strict_cap(seconds: Column, most: int = 4) -> Column:
    """(period, multiple) of the first display period that a duration lies on at a multiple of at most `most`; else null."""
    found = F.lit(None).cast("struct<period: int, multiple: int>")
    for i, period in reversed(list(enumerate(CAP_PERIODS))):
        times = F.bround(seconds / F.lit(period))
        on = (times >= 1) & (times <= most) & (F.abs(seconds - times * F.lit(period)) <= F.lit(CAP_TOLERANCE * period))
        found = F.when(on, F.struct(F.lit(i).alias("period"), times.cast("int").alias("multiple"))).otherwise(found)
    return found


def clean_text(text: Column) -> Column:
    """Text of a header without zero characters, '-' where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.replace(text, F.lit("\0"), F.lit(""))), F.lit("")), F.lit("-"))


def speedup_ceiling(share: Column, workers: Column) -> Column:
    """The most that n workers can gain where a share stays serial or parallel: 1 / ((1 - s) + s / n)."""
    n = F.greatest(workers, F.lit(2))
    return F.when(share <= 0, F.lit(1.0)).otherwise(F.lit(1.0) / ((1 - share) + share / n))
