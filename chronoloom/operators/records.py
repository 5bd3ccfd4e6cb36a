"""Keys delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: Sequence[str], version: str, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest version.

    Nulls in a key form a key of their own; a null version is older than any other. Among rows of one key and version
    the greatest row (by its columns in order) is kept, so that the result does not depend on the partitioning.
    """
    columns = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(F.col(version).alias("_version"), *[F.col(c).alias(c) for c in columns])).alias("_last")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (session time zone UTC)."""
    return F.unix_micros(column.cast("timestamp"))
