"""Begin and end records become spans: stacks, queues and last-begin-wins, without a row of Python.

Records have a direction d (1 begin, -1 end) and a total order seq within the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut


def _depths(df: DataFrame, by: Sequence[str], seq: str, d: str, at: str | Column | None, hot: int) -> Cut:
    """df with _bad (an end that nothing opened) and _depth after the record; the depth never falls below zero."""
    summed = Cut(df, by, [seq], at, hot).running("_s", "sum", F.col(d))
    lowest = summed.running("_m", "min", F.col("_s")).running("_was", "min", F.col("_s"), inclusive=False)
    marked = lowest.column("_bad", (F.col(d) == -1) & (F.col("_s") < F.least(F.lit(0), F.coalesce("_was", F.lit(0)))))
    made = marked.column("_depth", F.col("_s") - F.least(F.lit(0), "_m"))
    return made._with(made.df.drop("_s", "_m", "_was"))


def stack_pairs(df: DataFrame, by: Sequence[str], seq: str = "seq", d: str = "d", time: str = "cycle", at: str | Column | None = None, hot: int = HOT) -> DataFrame:
    """Last-in-first-out pairs: every begin with level (1 outermost) and end_time, end_seq, null where it never closed.

    An end that nothing opened pairs with nothing; pairing_counts() tells how many there are. at is a number that rises
    with seq, needed where seq is none.
    """
    level = F.when(F.col(d) == 1, F.col("_depth")).otherwise(F.col("_depth") + 1)
    rows = _depths(df, by, seq, d, at, hot).where("not _bad").column("level", level)
    paired = rows.beside("_next", F.struct(F.col(d).alias("d"), F.col(time).alias("time"), F.col(seq).alias("seq")), by=[*by, "level"]).done()
    closes = F.col("_next.d") == -1
    paired = paired.withColumn("end_time", F.when(closes, F.col("_next.time"))).withColumn("end_seq", F.when(closes, F.col("_next.seq")))
    return paired.where(F.col(d) == 1).drop("_bad", "_depth", "_next", d)


def with_parent(pairs: DataFrame, by: Sequence[str], seq: str = "seq", at: str | Column | None = None, hot: int = HOT) -> DataFrame:
    """pairs with parent, the seq of the begin that encloses each, null at level 1. All begins count, closed or not."""
    place = F.col(seq) if at is None else F.col(at) if isinstance(at, str) else at
    holders = pairs.select(*by, F.col("level").alias("_level"), F.col(seq).alias("_seq"), place.alias("_at"), F.col(seq).alias("_holder"))
    asked = pairs.select(*by, (F.col("level") - 1).alias("_level"), F.col(seq).alias("_seq"), place.alias("_at"), F.struct(*pairs.columns).alias("_pair"))
    both = holders.unionByName(asked, allowMissingColumns=True)
    found = Cut(both, [*by, "_level"], ["_seq"], "_at", hot).running("parent", "last", F.col("_holder")).done()
    return found.where("_pair is not null").select("_pair.*", "parent")


def queue_pairs(df: DataFrame, by: Sequence[str], seq: str = "seq", d: str = "d", time: str = "cycle", at: str | Column | None = None, hot: int = HOT) -> DataFrame:
    """First-in-first-out pairs by..., nth, begin_seq, begin, end: the oldest open begin takes each end."""
    rows = _depths(df, by, seq, d, at, hot).where("not _bad").running("nth", "sum", F.lit(1), by=[*by, d]).done()
    begins = rows.where(F.col(d) == 1).select(*by, "nth", F.col(seq).alias("begin_seq"), F.col(time).alias("begin"))
    ends = rows.where(F.col(d) == -1).select(*by, "nth", F.col(time).alias("end"))
    return begins.join(ends, [*by, "nth"])


def last_begin_pairs(df: DataFrame, by: Sequence[str], seq: str = "seq", d: str = "d", time: str = "cycle", at: str | Column | None = None, hot: int = HOT) -> DataFrame:
    """by..., begin, end: an end pairs with the record right before it if that is a begin; an overwritten begin is lost."""
    rows = Cut(df, by, [seq], at, hot).beside("_was", F.struct(F.col(d).alias("d"), F.col(time).alias("time")), -1).done()
    return rows.where((F.col(d) == -1) & (F.col("_was.d") == 1)).select(*by, F.col("_was.time").alias("begin"), F.col(time).alias("end"), F.col(seq).alias("end_seq"))


def pairing_counts(df: DataFrame, by: Sequence[str], seq: str = "seq", d: str = "d", at: str | Column | None = None, hot: int = HOT) -> DataFrame:
    """by..., pairs, unpaired_ends, unpaired_begins."""
    counted = _depths(df, by, seq, d, at, hot).done().groupBy(*by).agg(F.count_if(F.col(d) == 1).alias("_begins"), F.count_if((F.col(d) == -1) & ~F.col("_bad")).alias("pairs"), F.count_if("_bad").alias("unpaired_ends"))
    return counted.select(*by, "pairs", "unpaired_ends", (F.col("_begins") - F.col("pairs")).alias("unpaired_begins"))
