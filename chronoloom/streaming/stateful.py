"""Structured Streaming variants: windowed distributions with late data, and keyed state for stacks and interval maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronoloom.operators.interval_map import SHARD, IntervalMap


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str = "1 minute", lateness: str = "5 minutes", budget: float | None = None, value: str | None = None) -> DataFrame:
    """Rows per key and tumbling window, and how many are over a budget; rows later than lateness are dropped."""
    over = F.count_if(F.col(value) > budget) if value is not None and budget is not None else F.lit(None).cast("long")
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), over.alias("over"))


class _Stacks(StatefulProcessor):
    """The stack of a key in keyed state: how deep it is, and each open begin by its level. A record touches its top only."""

    def __init__(self, names: Sequence[str], ttl_ms: int | None) -> None:
        self.names, self.ttl = list(names), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", "n long", self.ttl)
        self.open = handle.getMapState("open", "level long", "seq long, cycle long, spec string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        deep = self.depth.get()[0] if self.depth.exists() else 0
        batch = pd.concat(list(rows)).sort_values("seq")
        fresh: dict[int, tuple] = {}  # begins of this batch that are still open, not yet written
        done = []
        for seq, cycle, spec, d in zip(batch["seq"], batch["cycle"], batch["spec"], batch["d"], strict=True):
            if d == 1:
                deep += 1
                fresh[deep] = (int(seq), int(cycle), spec)
                continue
            held = fresh.pop(deep, None)
            if held is None and deep and self.open.containsKey((deep,)):
                held = self.open.getValue((deep,))
                self.open.removeKey((deep,))
            if held is None:  # nothing is open, or what was has expired
                done.append((key[0], int(seq), None, int(cycle), 0, None))
            else:
                done.append((key[0], held[0], held[1], int(cycle), deep, held[2]))
            deep = max(0, deep - 1)
        for level, begin in fresh.items():
            self.open.updateValue((level,), begin)
        self.depth.update((deep,))
        yield pd.DataFrame(done, columns=self.names).astype({n: "Int64" for n in self.names[:-1]})

    def close(self) -> None:
        pass


def stream_stack_pairs(stream: DataFrame, key: str = "tid", ttl_ms: int | None = None) -> DataFrame:
    """Last-in-first-out pairs of begin and end records that arrive in order of seq per key.

    stream has key, seq, cycle, spec, d. The state of a key is its stack of open begins, an entry a level, so a batch writes
    only what it opens and closes; a pair leaves when it closes. An end that nothing opened leaves with a null begin. With
    ttl_ms a begin that stays open longer than that expires. Needs the RocksDB state store.
    """
    out = StructType([StructField(key, LongType()), *[StructField(n, LongType()) for n in ("seq", "begin", "end", "level")], StructField("spec", StringType())])
    return stream.groupBy(key).transformWithStateInPandas(_Stacks(out.names, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime")


class _Periods(StatefulProcessor):
    """The interval map of a key in keyed state, an entry a time shard: a batch reads and writes the shards it touches."""

    def __init__(self, names: Sequence[str], begin: str, end: str, shard: int) -> None:
        self.names, self.begin, self.end, self.shard = list(names), begin, end, shard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "shard long", "starts array<long>, ends array<long>")
        self.totals = handle.getValueState("totals", "periods long, covered long, first long, last long")

    def _load(self, shard: int) -> IntervalMap:
        return IntervalMap(*map(list, self.spans.getValue((shard,)))) if self.spans.containsKey((shard,)) else IntervalMap()

    def _seen(self, maps: dict[int, IntervalMap], touched: set[int]) -> tuple[int, int]:
        """Periods and covered time of the touched shards; what meets at a border is one period."""
        border = lambda s: (s + 1) * self.shard
        meets = lambda s: bool(maps[s].ends and maps[s + 1].starts and maps[s].ends[-1] == border(s) == maps[s + 1].starts[0])
        pieces = sum(len(maps[t].starts) for t in touched)
        return pieces - sum(meets(s) for s in {x for t in touched for x in (t - 1, t)}), sum(e - b for t in touched for b, e in maps[t].periods())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).dropna(subset=[self.begin, self.end])
        found = [(int(b), int(e)) for b, e in zip(batch[self.begin], batch[self.end], strict=True) if e > b]
        if not found:
            return
        touched = {s for b, e in found for s in range(b // self.shard, (e - 1) // self.shard + 1)}
        maps = {s: self._load(s) for t in touched for s in (t - 1, t, t + 1)}
        periods, covered, first, last = self.totals.get() if self.totals.exists() else (0, 0, found[0][0], found[0][1])
        was = self._seen(maps, touched)
        for b, e in found:
            for s in range(b // self.shard, (e - 1) // self.shard + 1):
                maps[s].insert(max(b, s * self.shard), min(e, (s + 1) * self.shard))
        now = self._seen(maps, touched)
        for t in touched:
            self.spans.updateValue((t,), (maps[t].starts, maps[t].ends))
        periods, covered = periods + now[0] - was[0], covered + now[1] - was[1]
        first, last = min(first, *(b for b, _ in found)), max(last, *(e for _, e in found))
        self.totals.update((periods, covered, first, last))
        yield pd.DataFrame([(key[0], periods, last - first - covered, covered, first, last)], columns=self.names)

    def close(self) -> None:
        pass


def stream_periods(stream: DataFrame, key: str = "entity", begin: str = "b", end: str = "e", shard: int = SHARD) -> DataFrame:
    """The continuous periods of each key so far (update mode): key, periods, gaps_us, covered, first, last.

    The state of a key is its ordered map of disjoint intervals, cut at the borders of time shards, so a batch touches only
    the shards that its spans lie in; spans may come in any order and more than once. Needs the RocksDB state store.
    """
    out = StructType([StructField(key, StringType()), *[StructField(n, LongType()) for n in ("periods", "gaps_us", "covered", "first", "last")]])
    return stream.groupBy(key).transformWithStateInPandas(_Periods(out.names, begin, end, shard), out, "Update", "None")
