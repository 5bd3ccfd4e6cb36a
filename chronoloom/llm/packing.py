"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in randomised groups of items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

GROUP_ITEMS = 20_000
SEED = 17
_GROUP_SHIFT = 2**32


class FirstFit:
    """Containers in order of opening, in a tree whose inner nodes hold the most room among their leaves."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves, self.tree, self.opened = capacity, 1, [0, capacity], 0

    def place(self, size: int) -> int:
        """The first container with room for the size, which is at most the capacity; a new one where none has it."""
        if self.tree[1] < size:
            self._grow()
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        at = node - self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
        if at >= self.opened:
            self.opened = at + 1
        return at

    def _grow(self) -> None:
        """Twice as many leaves: unopened containers are leaves with all their room, behind the opened ones."""
        leaves = self.leaves * 2
        level = [*self.tree[self.leaves :], *[self.capacity] * self.leaves]
        levels = [level]
        while len(level) > 1:
            level = [max(level[i], level[i + 1]) for i in range(0, len(level), 2)]
            levels.append(level)
        self.tree = [0, *[x for level in reversed(levels) for x in level]]
        self.leaves = leaves


def _fill(capacity: int, schema: pa.Schema):
    """Rows (key, tokens, group), sorted by group and falling size, to one row for each part of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins, whole = None, FirstFit(capacity), 0
        for batch in batches:
            keys, parts, firsts, sizes, places = [], [], [], [], []
            for at, (size, group) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if group != current:
                    current, bins, whole = group, FirstFit(capacity), 0
                full, rest = divmod(size, capacity)
                for part in range(full):  # full parts fill a container of their own, numbered from the top
                    whole += 1
                    keys.append(at)
                    parts.append(part)
                    firsts.append(part * capacity)
                    sizes.append(capacity)
                    places.append(current * _GROUP_SHIFT + _GROUP_SHIFT - whole)
                if rest or not full:
                    keys.append(at)
                    parts.append(full)
                    firsts.append(full * capacity)
                    sizes.append(rest)
                    places.append(current * _GROUP_SHIFT + bins.place(rest))
            columns = [batch.column(0).take(pa.array(keys, pa.int64()))]
            columns += [pa.array(c, f.type) for c, f in zip((parts, firsts, sizes, places), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS, seed: int = SEED, total: int | None = None) -> DataFrame:
    """key, part, first, size, container: where each part of each item lies. No item is left out or repeated.

    An item is divided only if it alone exceeds the capacity, into full parts and a rest. Items are dealt to groups of
    about group_items by a hash of key and seed, each packed on its own by first-fit decreasing (equal sizes in order
    of key), so a group costs one task of bounded size and at most one half-empty container or so. An item of size 0
    or null goes where there is room, with size 0; a negative size counts as 0. Repeated keys are items of their own;
    an empty table gives no rows. container is unique over all groups. total is the number of items where it is known
    already, so that items that are dear to make are not made only to be counted; it decides the number of groups.
    """
    named = items.select(F.col(f"`{key}`").alias("_key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    total = items.select(F.lit(1)).count() if total is None else total
    groups = max(1, -(-total // group_items))
    placed = named.withColumn("_group", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(groups)).cast("long"))
    ordered = placed.repartition("_group").sortWithinPartitions("_group", F.col("_size").desc(), "_key")
    schema = StructType([StructField(key, items.schema[key].dataType), StructField("part", IntegerType()), StructField("first", LongType()), StructField("size", LongType()), StructField("container", LongType())])
    return ordered.mapInArrow(_fill(capacity, to_arrow_schema(schema)), schema)
