"""Who works inside whose frames: every thread's time in every frame it overlaps, alone, beside others and in locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.asof import forward
from chronoloom.operators.hot import HOT
from chronoloom.operators.intervals import difference, merged, overlap_join, segments, sweep, union_length
from chronoloom.session import cut_lineage

KINDS = ("busy", "wait", "lock")


def thread_totals(spans: DataFrame, by: Sequence[str], hot: int = HOT) -> DataFrame:
    """by..., tid, spans, busy, wait, lock: the covered time of each kind of a thread, and its continuous busy stretches.

    spans has by..., tid, kind (busy for any scope; wait or lock for one that is that too), b and e.
    """
    made = union_length(spans, [*by, "tid", "kind"])
    pick = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    return made.groupBy(*by, "tid").agg(pick("busy", "pieces").alias("spans"), *[pick(k, "covered").alias(k) for k in KINDS])


def occupancy(spans: DataFrame, frames: DataFrame, by: Sequence[str], hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Every frame's threads (by..., frame_id, tid, busy, wait, lock) and its own row (by..., frame_id, solo, others_work, all, peak, contended).

    frames has by..., frame_id, tid, b and e; spans as in thread_totals. Work is busy time without waits. solo: the frame's
    own thread works and no other does; others_work: any other thread works; all: any thread is busy; peak: the most
    threads working at once; contended: two or more are inside a lock. A frame that no span overlaps has no row.
    """
    own = frames.select(*by, "frame_id", F.col("tid").alias("f_tid"), "b", "e")
    # what overlaps inside one thread and kind becomes one stretch before it meets the frames
    whole = merged(spans, [*by, "tid", "kind"], hot=hot)
    pairs = overlap_join(whole, own, list(by))
    pieces = cut_lineage(pairs.select(*by, "frame_id", "f_tid", "tid", "kind", F.greatest("b", "r_b").alias("b"), F.least("e", "r_e").alias("e")))
    length = F.col("e") - F.col("b")
    frame = [*by, "frame_id"]
    threads = pieces.groupBy(*frame, "tid").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, length)), F.lit(0)).alias(k) for k in KINDS])
    busy, waits = pieces.where("kind = 'busy'"), pieces.where("kind = 'wait'")
    work = cut_lineage(difference(busy, waits, [*frame, "f_tid", "tid"], hot=hot))
    mine = (F.col("tid") == F.col("f_tid")).cast("int")
    open_ = segments(work, frame, {"own": mine, "other": 1 - mine}, hot=hot)
    time = F.col("until") - F.col("t")
    when = lambda c: F.sum(F.when(c, time).otherwise(0))
    worked = open_.groupBy(*frame).agg(when((F.col("own") > 0) & (F.col("other") == 0)).alias("solo"), when(F.col("other") > 0).alias("others_work"), F.max(F.col("own") + F.col("other")).alias("peak"))
    covered = union_length(busy, frame).select(*frame, F.col("covered").alias("all"))
    locked = sweep(pieces.where("kind = 'lock'"), frame).select(*frame, "contended")
    every = pieces.select(*frame).distinct()
    for part in (worked, covered, locked):
        every = every.join(part, frame, "left")
    return threads, every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("solo", "others_work", "peak", "all", "contended")})


def coverage(scopes: DataFrame, frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., frame_id, covered, waiting: the time of each frame inside any scope, and inside one that waits.

    A scope (by..., waits, b, e) belongs to the first frame (by..., frame_id, f_b, f_e) that ends at or after its end, if
    that has begun by then, and counts from the frame's begin on.
    """
    found = forward(scopes, frames, by, "e", "f_e", ["frame_id"]).where("f_b <= e")
    pieces = cut_lineage(found.select(*by, "frame_id", "waits", F.greatest("b", "f_b").alias("b"), "e"))
    keys = [*by, "frame_id"]
    covered = union_length(pieces, keys).select(*keys, "covered")
    waiting = union_length(pieces.where("waits"), keys).select(*keys, F.col("covered").alias("waiting"))
    return covered.join(waiting, keys, "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))


def beside(threads: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., tid, frames, busy, wait, lock, elsewhere: threads in the frames, and those busy only outside of them."""
    inside = threads.groupBy(*by, "tid").agg(F.count(F.lit(1)).alias("frames"), *[F.sum(k).alias(k) for k in KINDS]).withColumn("elsewhere", F.lit(False))
    out = totals.where("busy > 0").join(inside.select(*by, "tid"), [*by, "tid"], "left_anti").select(*by, "tid", F.lit(0).cast("long").alias("frames"), *[F.lit(0).cast("long").alias(k) for k in KINDS], F.lit(True).alias("elsewhere"))
    return inside.unionByName(out)
