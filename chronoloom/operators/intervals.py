"""Interval algebra as windows: union, sweep, difference, clipping and the overlap join on buckets of fitting width.

Every helper takes the columns that partition the work and half-open borders b < e in whole ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut


def merged(df: DataFrame, by: Sequence[str], b: str = "b", e: str = "e", hot: int = HOT) -> DataFrame:
    """Disjoint intervals per key: what overlaps or touches becomes one. Empty and reversed intervals are left out."""
    rows = df.where(F.col(e) > F.col(b)).select(*by, b, e)
    far = Cut(rows, by, [b, e], b, hot).running("_far", "max", F.col(e), inclusive=False)
    fresh = F.when(F.col(b) <= F.col("_far"), 0).otherwise(1)
    islands = far.running("_island", "sum", fresh).done()
    return islands.groupBy(*by, "_island").agg(F.min(b).alias(b), F.max(e).alias(e)).drop("_island")


def union_length(df: DataFrame, by: Sequence[str], b: str = "b", e: str = "e") -> DataFrame:
    """by..., pieces, covered: how many disjoint intervals there are and how much they cover."""
    return merged(df, by, b, e).groupBy(*by).agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col(e) - F.col(b)).alias("covered"))


def clipped(b: Column, e: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The borders of [b, e) inside [low, high)."""
    return F.greatest(b, low), F.least(e, high)


def segments(df: DataFrame, by: Sequence[str], weights: dict[str, Column], b: str = "b", e: str = "e", hot: int = HOT) -> DataFrame:
    """by..., t, until and, for each weight, its sum over the intervals open on [t, until).

    All changes at one instant are added up first, so touching intervals are never open together.
    """
    names = list(weights)
    rows = df.where(F.col(e) > F.col(b)).select(*by, F.col(b).alias("_b"), F.col(e).alias("_e"), *[w.alias(n) for n, w in weights.items()])
    change = F.explode(F.array(F.struct(F.col("_b").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("t"), F.lit(-1).alias("d"))))
    steps = rows.withColumn("_c", change).groupBy(*by, F.col("_c.t").alias("t")).agg(*[F.sum(F.col(n) * F.col("_c.d")).alias(n) for n in names])
    cut = Cut(steps, by, ["t"], "t", hot).beside("until", F.col("t"))
    for n in names:
        cut = cut.running(f"_sum_{n}", "sum", F.col(n))
    return cut.done().where("until is not null").select(*by, "t", "until", *[F.col(f"_sum_{n}").alias(n) for n in names])


def sweep(df: DataFrame, by: Sequence[str], b: str = "b", e: str = "e") -> DataFrame:
    """by..., covered, peak, contended: time with any interval open, most open at once, time with two or more open."""
    length = F.col("until") - F.col("t")
    open_ = segments(df, by, {"n": F.lit(1)}, b, e)
    return open_.groupBy(*by).agg(
        F.sum(F.when(F.col("n") > 0, length).otherwise(0)).alias("covered"),
        F.max("n").alias("peak"),
        F.sum(F.when(F.col("n") > 1, length).otherwise(0)).alias("contended"),
    )


def difference(own: DataFrame, others: DataFrame, by: Sequence[str], b: str = "b", e: str = "e", hot: int = HOT) -> DataFrame:
    """The stretches of own that no interval of others covers, merged."""
    both = own.select(*by, b, e, F.lit(1).alias("_own")).unionByName(others.select(*by, b, e, F.lit(0).alias("_own")))
    parts = segments(both, by, {"own": F.col("_own"), "other": 1 - F.col("_own")}, b, e, hot).where("own > 0 and other = 0")
    return merged(parts.select(*by, F.col("t").alias(b), F.col("until").alias(e)), by, b, e, hot)


FACTOR = 3  # each level's buckets are 2^FACTOR times as wide as those of the level below


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], b: str = "b", e: str = "e") -> DataFrame:
    """Pairs of left and right with equal keys whose intervals overlap, by an equi-join on buckets that fit each length.

    left's borders are b and e, right's come out as r_b and r_e; other columns of both come along and must differ.
    An interval lives at the level whose buckets are just as wide as it is long, so it touches at most two of them; to
    the levels above it is a visitor, of at most two buckets each. Two intervals meet at the level of the longer one, once:
    in the bucket where the later of them begins. So an interval is copied a bounded number of times (twice for each
    level in use on the other side), however long it or others are, and no width has to be chosen.
    """
    other = right.withColumnsRenamed({b: "r_b", e: "r_e"})

    def leveled(df: DataFrame, low: str, high: str) -> DataFrame:
        return df.where(F.col(high) > F.col(low)).withColumn("_own", F.ceil(F.log2(F.col(high) - F.col(low)) / FACTOR).cast("int"))

    def bucketed(df: DataFrame, low: str, high: str, own: str, met: list[int]) -> DataFrame:
        used = F.array_union(F.array(F.col(own)), F.filter(F.array(*[F.lit(v) for v in met]), lambda v: v > F.col(own)))
        rows = df.withColumn("_level", F.explode(used))
        at = lambda c: F.expr(f"shiftright(cast({c} as bigint), _level * {FACTOR})")
        return rows.withColumn("_bucket", F.explode(F.sequence(at(f"`{low}`"), at(f"`{high}` - 1"))))

    lefts, rights = leveled(left, b, e), leveled(other, "r_b", "r_e")
    used = lefts.select("_own", F.lit(0).alias("_side")).unionByName(rights.select("_own", F.lit(1).alias("_side"))).distinct().collect()  # at most 64 / FACTOR rows a side
    left_levels, right_levels = (sorted(r._own for r in used if r._side == side) or [0] for side in (0, 1))
    one = bucketed(lefts.withColumnRenamed("_own", "_left"), b, e, "_left", right_levels)
    two = bucketed(rights.withColumnRenamed("_own", "_right"), "r_b", "r_e", "_right", left_levels)
    pairs = one.join(two, [*by, "_level", "_bucket"])
    first = F.greatest(F.col(b), F.col("r_b"))
    at_first = F.expr(f"shiftright(cast(greatest(`{b}`, r_b) as bigint), _level * {FACTOR})")
    met = (first < F.least(e, "r_e")) & (F.col("_level") == F.greatest("_left", "_right")) & (F.col("_bucket") == at_first)
    return pairs.where(met).drop("_bucket", "_level", "_left", "_right")
