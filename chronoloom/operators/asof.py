"""As-of joins: one sorted pass over both sides of each key, in shards where a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut


def _both(points: DataFrame, windows: DataFrame, by: Sequence[str], at: str, key: str, side: int) -> DataFrame:
    left = points.select(*by, F.struct(*points.columns).alias("_point"), F.col(at).alias("_at"), F.lit(1 - side).alias("_side"))
    right = windows.select(*by, F.struct(*windows.columns).alias("_window"), F.col(key).alias("_at"), F.lit(side).alias("_side"))
    return left.unionByName(right, allowMissingColumns=True)


def _found(both: DataFrame, by: Sequence[str], order: list[Column], at: Column, points: DataFrame, windows: DataFrame, hot: int) -> DataFrame:
    rows = Cut(both, by, order, at, hot).running("_found", "last", F.col("_window")).done().where("_point is not null")
    return rows.select("_point.*", *[F.col(f"_found.{c}").alias(c) for c in windows.columns if c not in by])


def forward(points: DataFrame, windows: DataFrame, by: Sequence[str], at: str, key: str, ties: Sequence[str], hot: int = HOT) -> DataFrame:
    """Each point with the first window whose key (its end) is at or after the point; nulls where there is none.

    Of windows with one key the least by ties counts. The pass runs from the last row to the first, so what it carries
    is one window; a frame that looked ahead would be searched anew for every row.
    """
    order = [F.col("_at").desc(), F.col("_side").desc(), *[F.col(f"_window.{t}").desc() for t in ties]]
    return _found(_both(points, windows, by, at, key, 1), by, order, -F.col("_at"), points, windows, hot)


def backward(points: DataFrame, windows: DataFrame, by: Sequence[str], at: str, key: str, ties: Sequence[str], hot: int = HOT) -> DataFrame:
    """Each point with the last window whose key (its begin) is at or before the point; nulls where there is none."""
    order = [F.col("_at").asc(), F.col("_side").asc(), *[F.col(f"_window.{t}").asc() for t in ties]]
    return _found(_both(points, windows, by, at, key, 0), by, order, F.col("_at"), points, windows, hot)


def contained(points: DataFrame, windows: DataFrame, by: Sequence[str], at: str, begin: str, end: str, ties: Sequence[str], hot: int = HOT) -> DataFrame:
    """Each point with the first window that ends at or after it, if that has begun by then; nulls otherwise."""
    found = forward(points, windows, by, at, end, ties, hot)
    holds = F.col(begin) <= F.col(at)
    return found.select(*points.columns, *[F.when(holds, F.col(c)).alias(c) for c in windows.columns if c not in by])
