"""Tasks of a scheduler from their events: lifecycle, waits, dependencies and where their steps fall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.asof import contained
from chronoloom.operators.hot import HOT
from chronoloom.operators.pairing import last_begin_pairs

# fixed values: the kinds of events that stamp a task, in the order of its life, and the two that bracket a wait
STAMPS = ("Created", "Launched", "Scheduled", "Started", "Finished", "Completed", "Destroyed")
WAIT_BEGIN, WAIT_END, EDGE = "WaitingStarted", "WaitingFinished", "SubsequentAdded"
KEPT = 512


def lifecycle(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., task, a stamp per kind, name, size, execute_on, tracked, started_tid, finished_tid.

    events has by..., tid, seq, kind, task, stamp, size, text, execute_on and tracked; (tid, seq) is their order. The last
    stamp of each kind counts, null where the kind never came. name, execute_on and tracked come with the last Launched,
    size with the last Created or Launched, the thread ids with the last Started and Finished.
    """
    order = F.struct("tid", "seq")
    last = lambda column, *kinds: F.max_by(F.when(F.col("kind").isin(*kinds), F.col(column)), F.when(F.col("kind").isin(*kinds), order))
    rows = events.where(F.col("kind").isin(*STAMPS) & F.col("task").isNotNull())
    return rows.groupBy(*by, "task").agg(
        *[last("stamp", k).alias(k.lower()) for k in STAMPS],
        last("text", "Launched").alias("name"),
        last("size", "Created", "Launched").alias("size"),
        last("execute_on", "Launched").alias("execute_on"),
        last("tracked", "Launched").alias("tracked"),
        last("tid", "Started").alias("started_tid"),
        last("tid", "Finished").alias("finished_tid"),
    )


def duration() -> Column:
    """How long a task ran: null where it never did, zero where its stamps are the wrong way round."""
    return F.when(F.col("started").isNotNull() & F.col("finished").isNotNull(), F.greatest(F.lit(0), F.col("finished") - F.col("started")))


def waits(events: DataFrame, by: Sequence[str], hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Waits by..., tid, begin, end; and by..., events that brackets no wait ('unreadable').

    A wait begins anew with every start, so of several starts the last counts. An end without a start, and a thread whose
    last start has no end, are unreadable; a start that another one replaces is not.
    """
    rows = events.where(F.col("kind").isin(WAIT_BEGIN, WAIT_END)).withColumn("d", F.when(F.col("kind") == WAIT_BEGIN, 1).otherwise(-1))
    found = last_begin_pairs(rows, [*by, "tid"], "seq", "d", "stamp", hot=hot)
    paired = found.groupBy(*by).agg(F.count(F.lit(1)).alias("_pairs"))
    open_ = rows.groupBy(*by, "tid").agg(F.max_by("d", "seq").alias("_last"), F.count_if(F.col("d") == -1).alias("_ends")).groupBy(*by).agg(F.count_if(F.col("_last") == 1).alias("_open"), F.sum("_ends").alias("_ends"))
    joined = open_.join(paired, list(by), "left") if by else open_.crossJoin(paired)  # without keys one row beside one row
    unread = joined.select(*by, (F.col("_ends") - F.coalesce("_pairs", F.lit(0)) + F.col("_open")).alias("unreadable"))
    return found.select(*by, "tid", "begin", "end"), unread


def edges(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., pred, succ: each dependency once, whether its tasks are known or not."""
    return events.where(F.col("kind") == EDGE).select(*by, F.col("task").alias("pred"), F.col("other").alias("succ")).where("pred is not null and succ is not null").distinct()


def linked(tasks: DataFrame, links: DataFrame, by: Sequence[str]) -> DataFrame:
    """tasks with prerequisites and subsequents, the sorted ids that they depend on and that depend on them."""
    before = links.groupBy(*by, F.col("succ").alias("task")).agg(F.sort_array(F.collect_set("pred")).alias("prerequisites"))
    after = links.groupBy(*by, F.col("pred").alias("task")).agg(F.sort_array(F.collect_set("succ")).alias("subsequents"))
    none = F.array().cast("array<bigint>")
    joined = tasks.join(before, [*by, "task"], "left").join(after, [*by, "task"], "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("prerequisites", "subsequents")})


def among(links: DataFrame, kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """The links both of whose tasks are kept (by..., task)."""
    ends = lambda name: kept.select(*by, F.col("task").alias(name))
    return links.join(ends("pred"), [*by, "pred"], "left_semi").join(ends("succ"), [*by, "succ"], "left_semi").select(*by, "pred", "succ")


def placed(steps: DataFrame, frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """steps (by..., tid, begin) with frame_id, the frame (by..., tid, b, e, frame_id) of its thread that holds its begin."""
    return contained(steps, frames, [*by, "tid"], "begin", "b", "e", ["frame_id"]).drop("b", "e")
