"""Matching records by nearest time with a piecewise-linear learned index per entity and time shard.

Both sides are cut into time shards per entity; a record of the searched side that lies within the tolerance of a
shard's border is also copied into the neighbour, so every shard answers its own queries alone. In a shard the sorted
times get a piecewise-linear model that predicts a position with an error of at most ERROR places; the exact
neighbours are found by a search in that short stretch of the sorted array.

Times are whole numbers in units of 1 / (scale * 10^6) seconds, counted from the start of the shard: nothing is rounded
and nothing overflows for scales up to MOST_SCALE ticks per second.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

ERROR = 16
SHARD_SECONDS = 10
MOST_SCALE = 4 * 10**11
LEAST_LIMIT = 10**10


class LearnedIndex:
    """Positions in a sorted array of distinct integers, by line segments found with a shrinking cone of slopes."""

    def __init__(self, keys: np.ndarray, error: int = ERROR) -> None:
        self.keys, self.error = keys, error
        values = (keys - keys[0]).astype(np.float64).tolist()
        starts, places, slopes = [], [], []
        at, x0, low, high = 0, 0.0, 0.0, float("inf")
        for i in range(1, len(values)):
            dx, dy = values[i] - x0, i - at
            if dx * low <= dy + error and dx * high >= dy - error and dx > 0:
                low, high = max(low, (dy - error) / dx), min(high, (dy + error) / dx)
                continue
            starts.append(x0)
            places.append(at)
            slopes.append((low + high) / 2 if high < float("inf") else 0.0)
            at, x0, low, high = i, values[i], 0.0, float("inf")
        starts.append(x0)
        places.append(at)
        slopes.append((low + high) / 2 if high < float("inf") else 0.0)
        self.starts, self.places, self.slopes = np.array(starts), np.array(places, np.float64), np.array(slopes)
        self.limits = np.append(self.places[1:], len(keys))

    def first_at_least(self, values: np.ndarray) -> np.ndarray:
        """For each value the position of the first key >= value."""
        keys, n = self.keys, len(self.keys)
        x = (values - keys[0]).astype(np.float64)
        segment = np.maximum(np.searchsorted(self.starts, x, "right") - 1, 0)
        guess = self.places[segment] + self.slopes[segment] * (x - self.starts[segment])
        guess = np.clip(guess, self.places[segment], self.limits[segment]).astype(np.int64)
        low = np.maximum(guess - self.error - 1, 0)
        high = np.minimum(guess + self.error + 2, n)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) >> 1, n - 1)
            less = keys[middle] < values
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        # the neighbours decide; where rounding of huge values broke the bound, the whole array is searched
        wrong = ((low > 0) & (keys[np.maximum(low - 1, 0)] >= values)) | ((low < n) & (keys[np.minimum(low, n - 1)] < values))
        if wrong.any():
            low[wrong] = np.searchsorted(keys, values[wrong])
        return low


def match_shard(times: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(left id, right id) of the nearest record of each query within the tolerance; all sorted by time, then id."""
    first = np.ones(len(times), bool)
    first[1:] = times[1:] != times[:-1]  # of equal times the smallest id stands first
    times, ids = times[first], ids[first]
    again = np.zeros(len(asked), bool)
    again[1:] = (asked[1:] == asked[:-1]) & (asked_ids[1:] == asked_ids[:-1])
    asked, asked_ids = asked[~again], asked_ids[~again]
    right = LearnedIndex(times).first_at_least(asked)
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(times) - 1)
    to_left, to_right = np.abs(asked - times[left]), np.abs(times[right] - asked)
    best = np.where(to_left <= to_right, left, right)
    near = np.minimum(to_left, to_right) <= tolerance
    return ids[best[near]], asked_ids[near]


def _match(keys: int, tolerance_us: int, schema: pa.Schema):
    """Over rows (keys..., shard, scale, side, time, id) sorted in that order; shards that end leave, one is held."""
    head = keys + 2

    def answer(block: np.ndarray, borders: list[int]) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in zip(borders, borders[1:], strict=False):
            cut = a + int(np.searchsorted(block[a:b, head], 1))
            if a < cut < b:
                found.append(match_shard(block[a:cut, head + 1], block[a:cut, head + 2], block[cut:b, head + 1], block[cut:b, head + 2], tolerance_us * int(block[a, head - 1])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if np.any(held[0][0, :head] != held[-1][-1, :head]):
                block = np.concatenate(held)
                borders = [0, *(np.flatnonzero(np.any(block[1:, :head] != block[:-1, :head], axis=1)) + 1).tolist()]
                held = [block[borders[-1] :]]
                yield from answer(block, borders)
        if held:
            block = np.concatenate(held)
            borders = [0, *(np.flatnonzero(np.any(block[1:, :head] != block[:-1, :head], axis=1)) + 1).tolist(), len(block)]
            yield from answer(block, borders)

    return run


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance_us: int, shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """For each row of right the row of left nearest in time within the tolerance, both borders inclusive.

    Both sides have the integer columns keys (the entity), scale (ticks per second), ticks and id; ticks of left count
    the entity's own clock, ticks of right are microseconds of the same clock. Returns left_id and right_id, at most
    one row for each right_id. Of equally near rows the earlier counts, then the one with the smaller id. Rows with a
    null in one of these columns or a scale outside 1..MOST_SCALE match nothing; repeated rows count once; a right id
    given with several times comes out with the smallest left id found; empty tables give no rows; other columns, whatever
    their names, are ignored. A shard holds what one entity recorded in shard_seconds, or in more than twice the
    tolerance where that is longer; a tolerance above two minutes lowers the greatest scale in proportion, and one
    that would bring it below LEAST_LIMIT is a ValueError.
    """
    if tolerance_us < 0:
        raise ValueError("a tolerance is not negative")
    shard_seconds = max(shard_seconds, 2 * tolerance_us // 1_000_000 + 1)
    most_scale = min(MOST_SCALE, (2**63 - 1) // (2 * shard_seconds * 1_000_000))
    if most_scale < LEAST_LIMIT:
        raise ValueError(f"times within {tolerance_us} us cannot be compared as whole numbers at {LEAST_LIMIT} ticks a second")
    named = [f"_key{i}" for i in range(len(keys))]

    def prepared(df: DataFrame, second: str, part: str) -> DataFrame:
        columns = [F.col(f"`{k}`").cast("long").alias(n) for k, n in zip(keys, named, strict=True)]
        columns += [F.col(c).cast("long").alias(f"_{c}") for c in ("scale", "ticks", "id")]
        whole = df.select(*columns).dropna().where(f"_scale between 1 and {most_scale}")
        return whole.withColumn("_second", F.expr(second)).withColumn("_part", F.expr(part))

    # _second: whole seconds, _part: the rest in units of 1 / (scale * 10^6) seconds
    frames = prepared(left, "(_ticks - pmod(_ticks, _scale)) div _scale", "pmod(_ticks, _scale) * 1000000L")
    asked = prepared(right, "(_ticks - pmod(_ticks, 1000000L)) div 1000000L", "pmod(_ticks, 1000000L) * _scale")
    shard = f"(_second - pmod(_second, {shard_seconds}L)) div {shard_seconds}L"
    inside = f"pmod(_second, {shard_seconds}L) * 1000000L * _scale + _part"
    near, far = f"{tolerance_us}L * _scale", f"({shard_seconds * 1_000_000}L - {tolerance_us}L) * _scale"
    frames = (
        frames.withColumn("_home", F.expr(shard))
        .withColumn("_in", F.expr(inside))
        .withColumn("_move", F.explode(F.expr(f"case when _in <= {near} then array(0L, -1L) when _in >= {far} then array(0L, 1L) else array(0L) end")))
        .select(*named, (F.col("_home") + F.col("_move")).alias("_shard"), "_scale", F.lit(0).cast("long").alias("_side"), F.expr(f"_in - _move * {shard_seconds * 1_000_000}L * _scale").alias("_time"), "_id")
    )
    asked = asked.select(*named, F.expr(shard).alias("_shard"), "_scale", F.lit(1).cast("long").alias("_side"), F.expr(inside).alias("_time"), "_id")
    order = [*named, "_shard", "_scale", "_side", "_time", "_id"]
    both = frames.unionByName(asked).select(*order).repartition(*named, "_shard").sortWithinPartitions(*order)
    schema = StructType([StructField("left_id", LongType()), StructField("right_id", LongType())])
    found = both.mapInArrow(_match(len(keys), tolerance_us, to_arrow_schema(schema)), schema)
    return found.groupBy("right_id").agg(F.min("left_id").alias("left_id")).select("left_id", "right_id")
