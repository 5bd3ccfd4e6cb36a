"""Running values along an order within keys, also where one key holds a great share of all rows.

A window over a key sorts the whole key in one task. Keys of more than `hot` rows are therefore cut into shards at
quantiles of the order: each shard is a window of its own, and what a shard hands on (its sum, its greatest, its last
value) is folded over the few shards of the key and joined back. Keys below the bound are one shard, so both give the
same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut_lineage

HOT = 2_000_000
MOST_CUTS = 4_096

_SHARD = "_shard"


def _same(names: Sequence[str], prefix: str) -> Column:
    met = F.lit(True)
    for n in names:
        met = met & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return met


class Cut:
    """A table ordered within keys, whose hot keys are cut into shards; every method gives a new one with a column more.

    by are the keys, order further columns that make the order total (or columns with .desc()), at the number along
    which hot keys are cut: order must begin with it or rise with it. Rows of one value of at stay together. A null in
    at goes to the first shard, where nulls come first.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str | Column], at: str | Column | None = None, hot: int = HOT) -> None:
        self.by, self.order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
        at = F.col(at) if isinstance(at, str) else self.order[0] if at is None else at
        self.df, self.shards = _sharded(df, self.by, at, hot)

    def _with(self, df: DataFrame) -> Cut:
        made = object.__new__(Cut)
        made.by, made.order, made.shards, made.df = self.by, self.order, self.shards, df
        return made

    def column(self, name: str, value: Column) -> Cut:
        return self._with(self.df.withColumn(name, value))

    def where(self, condition: Column | str) -> Cut:
        return self._with(self.df.where(condition))

    def _window(self, by: Sequence[str], reverse: bool = False):
        order = [_reversed(c) for c in self.order] if reverse else self.order
        return Window.partitionBy(*by, *([_SHARD] if self.shards else [])).orderBy(*order)

    def running(self, name: str, kind: str, value: Column, inclusive: bool = True, by: Sequence[str] | None = None) -> Cut:
        """name: sum, max, min or last value that is not null of all rows up to this one (inclusive) or before it."""
        by = self.by if by is None else list(by)
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        rows = self._window(by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        own = self.df.withColumn(name, fold(value).over(rows))
        if not self.shards:
            return self._with(own)
        if kind == "last":
            ends = self.df.select(*by, _SHARD, value.alias("_hot_v"), F.row_number().over(self._window(by)).alias("_hot_n")).where("_hot_v is not null").groupBy(*by, _SHARD).agg(F.max_by("_hot_v", "_hot_n").alias("_hot_v"))
        else:
            ends = self.df.groupBy(*by, _SHARD).agg(fold(value).alias("_hot_v"))
        ends = self._every_shard(ends, by, ["_hot_v"])
        before = Window.partitionBy(*by).orderBy(_SHARD).rowsBetween(Window.unboundedPreceding, -1)
        joined = self._joined(own, ends.withColumn("_hot_v", fold(F.col("_hot_v")).over(before)), by)
        both = {
            "sum": F.coalesce(F.col(name) + F.col("_hot_v"), F.col(name), F.col("_hot_v")),
            "max": F.greatest(name, "_hot_v"),
            "min": F.least(name, "_hot_v"),
            "last": F.coalesce(name, "_hot_v"),
        }[kind]
        return self._with(joined.withColumn(name, both).drop("_hot_v"))

    def beside(self, name: str, value: Column, step: int = 1, by: Sequence[str] | None = None) -> Cut:
        """name: value of the next row (step 1) or the one before (step -1); null where there is none."""
        by = self.by if by is None else list(by)
        packed = F.struct(value.alias("v"))
        shift = (F.lead if step == 1 else F.lag)(packed).over(self._window(by))
        own = self.df.withColumn(name, shift)
        if not self.shards:
            return self._with(own.withColumn(name, F.col(f"{name}.v")))
        first = F.row_number().over(self._window(by, reverse=step == -1))
        ends = self.df.select(*by, _SHARD, packed.alias("_hot_v"), first.alias("_hot_n")).where("_hot_n = 1").drop("_hot_n")
        over = Window.partitionBy(*by).orderBy(_SHARD)
        ends = self._every_shard(ends, by, ["_hot_v"])
        far = F.first("_hot_v", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)) if step == 1 else F.last("_hot_v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
        joined = self._joined(own, ends.withColumn("_hot_v", far), by)
        return self._with(joined.withColumn(name, F.coalesce(name, "_hot_v")["v"]).drop("_hot_v"))

    def _every_shard(self, ends: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
        """ends with a row for each shard that has rows, also those without a value: rows are joined to it."""
        return self.df.select(*by, _SHARD).distinct().alias("_all").join(ends.select(*[F.col(b).alias(f"_hotkey_{b}") for b in [*by, _SHARD]], *values), _same([*by, _SHARD], "_hotkey_"), "left").select(*by, _SHARD, *values)

    def _joined(self, own: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
        names = [*by, _SHARD]
        right = carried.select(*[F.col(b).alias(f"_hotkey_{b}") for b in names], "_hot_v")
        return own.join(right, _same(names, "_hotkey_"), "left").drop(*[f"_hotkey_{b}" for b in names])

    def done(self) -> DataFrame:
        return self.df.drop(_SHARD) if self.shards else self.df


def _reversed(column: Column) -> Column:
    """The opposite order of an ascending column, nulls last."""
    return column.desc_nulls_last()


def _sharded(df: DataFrame, by: Sequence[str], at: Column, hot: int) -> tuple[DataFrame, bool]:
    """df, with _shard where any key has more than hot rows, and whether it has."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_hot_n")).where(F.col("_hot_n") > hot)
    most = sizes.agg(F.max("_hot_n")).first()[0]
    if most is None:
        return df, False
    parts = min(MOST_CUTS, -(-2 * most // hot))
    shares = [i / parts for i in range(1, parts)]
    large = sizes.select(*[F.col(b).alias(f"_hotkey_{b}") for b in by])
    cuts = df.withColumn("_hot_at", at).join(large, _same(by, "_hotkey_"), "left_semi").groupBy(*by).agg(F.percentile_approx("_hot_at", shares, max(10_000, 4 * parts)).alias("_hot_cuts"))
    cuts = cuts.select(*[F.col(b).alias(f"_hotkey_{b}") for b in by], F.array_distinct("_hot_cuts").alias("_hot_cuts"))
    joined = df.withColumn("_hot_at", at).join(cuts, _same(by, "_hotkey_"), "left")
    # a row's shard is how many cuts lie at or below it
    place = F.size(F.filter("_hot_cuts", lambda c: c <= F.col("_hot_at")))
    shard = F.when(F.col("_hot_cuts").isNull() | F.col("_hot_at").isNull(), F.lit(0)).otherwise(place)
    # written once: quantiles computed again could cut elsewhere
    return cut_lineage(joined.withColumn(_SHARD, shard).drop("_hot_cuts", "_hot_at", *[f"_hotkey_{b}" for b in by])), True
