"""The N best items of every group, by descending score bands.

The score range is cut into bands at quantiles of all scores, and the rows are written once, each band in a folder of its
own. Bands are read from the top: rows of groups that are already filled are anti-joined away, the rest are ranked
exactly, with ties, inside the band, and at most N items a group are kept. The walk ends with the first band after which
no group with rows below is open. The boundary band of a group is the one in which it fills; a last ranking over the few
kept rows trims it. A group of any size costs at most N rows per task after the map-side limit of the ranking window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut_lineage, written

FRACTIONS = (0.75, 0.45)
ACCURACY = 1000


def _best(df: DataFrame, n: int) -> DataFrame:
    """The n best of each group. dense_rank gives copies of one row one place, so none pushes others out; they leave as one."""
    order = Window.partitionBy("_g").orderBy(F.col("_score").desc(), "_item")
    return df.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= n).select("_g", "_score", "_item").distinct()


def top_n(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    item: str,
    n: int,
    fractions: Sequence[float] = FRACTIONS,
) -> DataFrame:
    """Columns group..., item, score, rank of the n items with the largest score in each group; ties: smaller item first.

    Rows with a null in a group column, a null item, or a null or NaN score are not ranked; 0.0 and -0.0 are equal.
    Copies of a row (same group, item and score) count once; an item given with several scores in a group is ranked with
    each of them. Groups of fewer than n items come out whole; an empty table gives no rows.
    """
    value = F.col(f"`{score}`")
    if dict(df.dtypes)[score] in ("double", "float"):
        value = F.when(~F.isnan(value), value + F.lit(0.0))
    groups = [F.col(f"`{c}`") for c in group]
    rows = df.select(F.struct(*[g.alias(f"_{i}") for i, g in enumerate(groups)]).alias("_g"), value.alias("_score"), F.col(f"`{item}`").alias("_item"))
    if len(group) == 1:
        rows = df.select(groups[0].alias("_g"), value.alias("_score"), F.col(f"`{item}`").alias("_item"))
        rows = rows.where("_g is not null")
    else:
        rows = rows.where(" and ".join(f"_g._{i} is not null" for i in range(len(group))))
    rows = rows.where("_score is not null and _item is not null")

    found = rows.agg(F.percentile_approx("_score", list(fractions), ACCURACY)).first()[0] if fractions else None
    cuts = sorted(set(found or ()), reverse=True)
    kept: DataFrame | None = None
    if cuts:
        band = F.lit(len(cuts))
        for at, cut in reversed(list(enumerate(cuts))):
            band = F.when(F.col("_score") >= F.lit(cut), F.lit(at)).otherwise(band)
        rows = written(rows.withColumn("_band", band), "_band")
    for at in range(len(cuts) + 1):
        here = rows.where(F.col("_band") == at).drop("_band") if cuts else rows
        if kept is not None:
            filled = kept.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("_g")
            here = here.join(filled, "_g", "left_anti")
        best = _best(here, n)
        if at < len(cuts):
            best = cut_lineage(best)
        kept = best if kept is None else kept.unionByName(best)
    final = Window.partitionBy("_g").orderBy(F.col("_score").desc(), "_item")
    result = kept.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= n)
    names = [F.col("_g").alias(group[0])] if len(group) == 1 else [F.col(f"_g._{i}").alias(c) for i, c in enumerate(group)]
    return result.select(*names, F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rank").alias("rank"))
