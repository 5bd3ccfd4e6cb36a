"""Distributions against an explicit budget: nearest ranks, doubling bins, choice of a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut

HITCH = 2.0
MOST_BINS = 16


@dataclass(frozen=True)
class Budget:
    """Milliseconds a frame may take, from frames per second or directly; never from both."""

    ms: float
    explicit: bool = True

    @staticmethod
    def of(fps: float | None = None, ms: float | None = None) -> Budget:
        if fps is not None and ms is not None:
            raise ValueError("give frames per second or milliseconds, not both")
        chosen = ms if ms is not None else 1000.0 / (60.0 if fps is None else fps)
        if not chosen > 0 or chosen == float("inf"):
            raise ValueError("a budget must be a positive number")
        return Budget(chosen, fps is not None or ms is not None)


def milliseconds(b: Column, e: Column, frequency: Column) -> Column:
    """Ticks to milliseconds; null without a frequency, never zero."""
    return (e - b) * F.lit(1000.0) / F.nullif(frequency, F.lit(0))


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], hot: int = HOT) -> DataFrame:
    """by..., n, one column r0, r1 ... for each share: the value at rank ceil(share * n), exact for a group of any size.

    Equal values are counted where they lie, and the counts run over the distinct values in order, in shards where a
    group has many: no task holds a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    running = Cut(counted, by, ["_v"], "_v", hot).running("_upto", "sum", F.col("_c")).done()
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("n")).select(*[F.col(b).alias(f"_r{b}") for b in by], "n")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r{b}"))
    joined = running.join(sizes, same)
    ranks = [F.min(F.when(F.col("_upto") >= F.ceil(F.round(F.lit(q) * F.col("n"), 9)), F.col("_v"))).alias(f"r{i}") for i, q in enumerate(shares)]
    return joined.groupBy(*by).agg(F.max("n").alias("n"), *ranks)


def distribution(df: DataFrame, by: Sequence[str], value: str, budget: float, mean: Column | None = None, hot: int = HOT) -> DataFrame:
    """count, mean, min, p50, p95, p99 (nearest ranks), max, over budget and hitches; nulls are not counted.

    mean may give the aggregate that makes the mean, such as one over whole ticks that no order of rows can change.
    """
    x = F.col(value)
    rows = df.where(x.isNotNull())
    plain = rows.groupBy(*by).agg(
        F.count(x).alias("n"),
        (F.avg(x) if mean is None else mean).alias("mean"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.count_if(x > budget).alias("over"),
        F.count_if(x > HITCH * budget).alias("hitches"),
    )
    ranks = nearest_ranks(rows.select(*by, value), by, value, (0.5, 0.95, 0.99), hot).select(*[F.col(b).alias(f"_r{b}") for b in by], F.col("r0").alias("p50"), F.col("r1").alias("p95"), F.col("r2").alias("p99"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r{b}"))
    return plain.join(ranks, same).drop(*[f"_r{b}" for b in by])


def histogram(df: DataFrame, by: Sequence[str], value: str, budget: float) -> DataFrame:
    """by..., bin, low, high, n: bins from zero, budget/2 and then doubling up to the maximum; the last is open.

    Empty bins are there with n 0.
    """
    rows = df.where(F.col(value).isNotNull())
    most = rows.groupBy(*by).agg(F.max(value).alias("_most"))
    # edges: budget / 2 * 2^k for k = 0.. while the next one does not pass the maximum
    doublings = F.greatest(F.lit(0), F.least(F.lit(MOST_BINS - 2), F.floor(F.log2(F.greatest(F.col("_most"), F.lit(budget / 2)) / F.lit(budget / 2)))))
    bins = most.select(*by, doublings.cast("int").alias("_k")).select(*by, "_k", F.explode(F.sequence(F.lit(0), F.col("_k") + 1)).alias("bin"))
    edge = lambda k: F.lit(budget / 2) * F.pow(F.lit(2.0), k)
    bins = bins.select(*by, "bin", F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(edge(F.col("bin") - 1)).alias("low"), F.when(F.col("bin") <= F.col("_k"), edge(F.col("bin"))).alias("high"))
    own = F.when(F.col(value) < budget / 2, F.lit(0)).otherwise(F.least(F.floor(F.log2(F.col(value) / F.lit(budget / 2))).cast("int") + 1, F.lit(MOST_BINS - 1)))
    counted = rows.select(*by, own.alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def busiest(df: DataFrame, by: Sequence[str], series: Sequence[str]) -> DataFrame:
    """by..., series..., n: the series with most rows in each group; ties go to the smallest key."""
    counted = df.groupBy(*by, *series).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), *series)
    return counted.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
