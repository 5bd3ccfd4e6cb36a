"""Overlapping and gapped time intervals: an ordered map of disjoint intervals per entity.

Plan: every span is cut at the borders of fixed time shards, so that a hot entity is spread over many tasks. The state
of a key (entity and shard) is an IntervalMap; spans are inserted as they come, in no order. Only the first and the last
interval of a shard can meet a neighbour, so all others leave as final rows and a pass over the edge rows of each entity,
in shards of its own where they are many, joins what crosses borders. A span over many shards is cut into its two ends
and one row for all shards between, which is joined to those shards alone that hold other spans: its length costs nothing.
One shuffle of the spans, one of at most two rows per shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from chronoloom.operators.hot import HOT, Cut
from chronoloom.operators.intervals import overlap_join
from chronoloom.session import cut_lineage

SHARD = 10_000_000


class IntervalMap:
    """Disjoint, non-touching half-open intervals in order, and the gap after each: binary search and a splice."""

    __slots__ = ("after", "ends", "starts")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)
        #: where the gap that begins at an end is over
        self.after = dict(zip(self.ends[:-1], self.starts[1:], strict=True)) if self.ends else {}

    def insert(self, begin: int, end: int) -> None:
        """Add [begin, end): everything it overlaps or touches becomes one interval. Empty or reversed: no change."""
        if end <= begin:
            return
        starts, ends, after = self.starts, self.ends, self.after
        low = bisect_left(ends, begin)
        high = bisect_right(starts, end)
        if low < high:
            if starts[low] <= begin and ends[low] >= end:
                return  # held already
            begin, end = min(begin, starts[low]), max(end, ends[high - 1])
            for gone in ends[low:high]:
                after.pop(gone, None)
        starts[low:high] = [begin]
        ends[low:high] = [end]
        if low:
            after[ends[low - 1]] = begin
        if low + 1 < len(starts):
            after[end] = starts[low + 1]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        """The stretch between each two neighbours."""
        return [(e, self.after[e]) for e in self.ends[:-1]]


def _fold(schema: pa.Schema):
    """Insert rows (keys..., shard, b, e), whose keys stand together, into the state of their key; rows (keys..., what, begin, end, joins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, IntervalMap(), []

        def close() -> None:
            entity = current[:-1]
            periods = held.periods()
            last = len(periods) - 1
            for at, (b, e) in enumerate(periods):
                edge = at in (0, last)
                # joins: whether the gap after an edge row is still to be found
                out.append((*entity, "edge" if edge else "period", b, e, at == last))
            out.extend((*entity, "gap", b, e, False) for b, e in held.gaps())

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *entity, b, e in zip(*columns, strict=True):
                entity = tuple(entity)
                if entity != current:
                    if current is not None:
                        close()
                    current, held = entity, IntervalMap()
                held.insert(b, e)
            if len(out) > 20_000:
                yield flush()
        if current is not None:
            close()
        if out:
            yield flush()

    return run


def periods_and_gaps(df: DataFrame, keys: Sequence[str], begin: str, end: str, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Continuous periods of the half-open spans [begin, end) per entity, and the gaps between successive periods.

    Returns keys..., what ('period' or 'gap'), begin, end. Spans that overlap, nest or touch merge. Spans with a null
    border, empty or reversed ones are left out; a null in a key is a value of its own. Repeated spans change nothing.
    An empty table gives no rows. Other columns of df, whatever their names, are not carried. shard is the width of a
    time shard in the unit of begin; an entity with more than hot shards has its edge rows joined in parts.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    spans = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)],
        F.col(f"`{begin}`").cast("long").alias("_b"),
        F.col(f"`{end}`").cast("long").alias("_e"),
    ).where("_e > _b")
    at = lambda c: F.expr(f"{c} - pmod({c}, {shard}L)")
    spans = spans.withColumn("_low", at("_b")).withColumn("_high", at("(_e - 1)"))
    borders = F.array_distinct(F.array("_low", "_high"))
    pieces = spans.withColumn("_at", F.explode(borders)).select(*named, "_at", F.greatest("_b", "_at").alias("_b"), F.least(F.col("_e"), F.col("_at") + shard).alias("_e"))
    # the shards between the ends of a span belong to it whole
    between = spans.where(F.col("_high") - F.col("_low") > shard).select(*named, (F.col("_low") + shard).alias("b"), F.col("_high").alias("e")).distinct()
    between = cut_lineage(between)
    held = not between.isEmpty()
    if held:
        there = pieces.select(*named, "_at").distinct().select(*[F.col(n).alias(f"_r{n}") for n in named], F.col("_at").alias("b"), (F.col("_at") + 1).alias("e"))
        # a null key is a value of its own, also here
        key = lambda prefix: F.struct(*[F.struct(F.col(f"{prefix}{n}").isNull().alias("n"), F.coalesce(F.col(f"{prefix}{n}").cast("string"), F.lit("")).alias("v")).alias(n) for n in named])
        met = overlap_join(between.withColumn("_k", key("")), there.withColumn("_k", key("_r")), ["_k"])
        pieces = pieces.unionByName(met.select(*named, F.col("r_b").alias("_at"), F.col("r_b").alias("_b"), (F.col("r_b") + shard).alias("_e")).distinct())
    pieces = pieces.repartition(*named, "_at").sortWithinPartitions(*named, "_at")
    fields = [StructField(n, df.schema[k].dataType) for k, n in zip(keys, named, strict=True)]
    schema = StructType([*fields, StructField("what", StringType()), StructField("_b", LongType()), StructField("_e", LongType()), StructField("_joins", BooleanType())])
    folded = cut_lineage(pieces.mapInArrow(_fold(to_arrow_schema(schema)), schema))

    ends = folded.where("what = 'edge'").select(*named, "_b", "_e", "_joins")
    if held:
        ends = ends.unionByName(between.select(*named, F.col("b").alias("_b"), F.col("e").alias("_e"), F.lit(True).alias("_joins")))
    islands = Cut(ends, named, ["_b"], "_b", hot).running("_far", "max", F.col("_e"), inclusive=False)
    islands = islands.running("_island", "sum", F.when(F.col("_b") <= F.col("_far"), 0).otherwise(1)).done()
    islands = islands.groupBy(*named, "_island").agg(F.min("_b").alias("_b"), F.max("_e").alias("_e"), F.max_by("_joins", "_b").alias("_joins"))
    edges = Cut(islands, named, ["_b"], "_b", hot).beside("_next", F.col("_b")).done()
    rows = edges.select(
        *named,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("what"), F.col("_b"), F.col("_e")),
                F.struct(F.lit("gap").alias("what"), F.col("_e").alias("_b"), F.when(F.col("_joins"), F.col("_next")).alias("_e")),
            )
        ).alias("_row"),
    ).select(*named, "_row.*")
    done = folded.where("what <> 'edge'").select(*named, "what", "_b", "_e").unionByName(rows.where("_e is not null"))
    return done.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], "what", F.col("_b").alias(begin), F.col("_e").alias(end))
