"""Implausible readings of a source: impossible values, stuck runs and brief spikes against its own scatter.

The core is an undecimated Haar wavelet decomposition of each source: a detail coefficient is the step between the
means of two neighbouring stretches, scaled robustly by the median of all details of that resolution. An excursion is
a step out and a step back within a few readings; a lasting change has no step back, drift has no step. Regular
recurrences are taken out before. Runs of zero detail reveal sticking, bounds detect impossible readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

WIDEST = 3
SIDE = 6
SPIKE = 5.5
STEP = 4.0
RESOLUTIONS = (1, 2)
ORDINARY = 3.5
LEAST_RUN = 6
LEAST_READINGS = 6
PERIODS = range(2, 13)
BLOCK = 50_000
CHUNK = 50_000
_NORMAL = 1.4826


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal readings, which are the runs of zero detail at the finest resolution."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return starts, np.diff(np.append(starts, len(x)))


def run_limit(pairs: int, equal: int, n: int) -> int:
    """The least stuck run among n readings, from the lengths of the usual runs: their sum, and what repeats in them."""
    # with share p of equal neighbours the longest run among n readings is near 1 + log n / log 1/p
    share = (equal + 0.5) / (pairs + 1.0)
    return max(LEAST_RUN, int(np.ceil(2 * (1 + np.log(max(n, 2)) / -np.log(min(share, 0.99))))) - 2)


def stuck(x: np.ndarray) -> np.ndarray:
    """Readings in runs much longer than chance makes them, judged by how often neighbours are equal elsewhere."""
    found = np.zeros(len(x), bool)
    starts, lengths = _runs(x)
    if len(starts) < 2:
        return found
    long = lengths >= LEAST_RUN
    if not long.any():
        return found
    usual = lengths[~long]
    limit = run_limit(usual.sum(), (usual - 1).sum(), len(x))
    for a, n in zip(starts[long], lengths[long], strict=True):
        if n >= limit:
            found[a : a + n] = True
    return found


def _median(x: np.ndarray) -> float:
    """np.median of a short array, without its overhead."""
    n = len(x)
    y = np.sort(x)
    return float(y[n // 2]) if n % 2 else float(y[n // 2 - 1] + y[n // 2]) / 2


def _middle(x: list[float]) -> float:
    n, y = len(x), sorted(x)
    return y[n // 2] if n % 2 else (y[n // 2 - 1] + y[n // 2]) / 2


def _departure(x: list[float], a: int, b: int, skip: list[bool], ends: bool) -> float:
    """How far all readings from a to b depart, in one direction, from the level before and from the level after.

    A level is the median of the SIDE readings next to them that are not to be skipped. At the very first or last
    reading of a source only one level is there: the nearest three readings and the drift that they show must then say
    the same.
    """
    n, part = len(x), x[a:b]
    left = [x[i] for i in range(a - 1, max(-1, a - 1 - SIDE - WIDEST), -1) if not skip[i]][:SIDE]
    right = [x[i] for i in range(b, min(n, b + SIDE + WIDEST)) if not skip[i]][:SIDE]
    if left and right:
        levels = [_middle(left), _middle(right)]
    elif ends and (a == 0 and len(right) >= 3 or b == n and len(left) >= 3):
        one = right or left
        near, far = _middle(one[:3]), _middle(one[-3:])
        drift = (near - far) / max(1, len(one) - 3)
        levels = [_middle(one), near, near + 2 * drift]
    else:
        return 0.0
    return max(min(part) - max(levels), min(levels) - max(part))


def details(x: np.ndarray, reach: int) -> np.ndarray:
    """The undecimated Haar detail of one resolution: mean of the reach readings from i on, less that of those before."""
    made = np.zeros(len(x))
    for n in range(1, reach + 1):  # sums of the few readings alone: the result does not depend on what lies far before
        at = np.arange(n, len(x) - n + 1)
        made[at] = (sum(x[at + i] for i in range(n)) - sum(x[at - 1 - i] for i in range(n))) / n
    return made


def _scale(x: np.ndarray, fixed: np.ndarray) -> float:
    """The source's own scatter from its finest details, repeats inside stuck runs left out.

    The median decides which details are ordinary; their standard deviation is a steadier measure than the median.
    """
    d = np.diff(x)
    d = d[~(fixed[1:] & fixed[:-1])]
    if len(d) == 0:
        return 0.0
    d = np.abs(d - _median(d))
    rough = _NORMAL * _median(d)
    if rough == 0.0:
        return 0.0
    ordinary = d[d <= ORDINARY * rough]
    return float(np.dot(ordinary, ordinary) / len(ordinary) / 2) ** 0.5


def _quantum(x: np.ndarray) -> float:
    """The least step between different readings."""
    u = np.unique(x)
    return float(np.diff(u).min()) if len(u) > 1 else 0.0


def off_base(x: np.ndarray) -> np.ndarray:
    """x less the median of the eleven readings around."""
    half = 5
    padded = np.pad(x, half, mode="reflect") if len(x) > half else np.pad(x, half, mode="edge")
    return x - np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)[:, half]


def recurring(counted: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which phases may recur, by how many of their readings stand out."""
    return (counted >= 3) & (counted >= 0.65 * sizes) & (2 * sizes <= n)


def without_recurrence(x: np.ndarray, at: np.ndarray, fixed: np.ndarray, scale: float, least: float) -> np.ndarray:
    """x less what comes back at one phase of a period, where most readings of that phase that are not stuck stand out alike."""
    n = len(x)
    if n < 9:
        return x
    rest = off_base(x)
    scale = max(min(scale, _NORMAL * _median(np.abs(rest[~fixed])) if not fixed.all() else scale), least)
    out = np.abs(rest) > STEP * scale
    if out.sum() < 3:
        return x
    best = None
    free, standing = ~fixed, np.flatnonzero(out & ~fixed)
    for period in PERIODS:
        phases = at % period
        counted = np.bincount(phases[standing], minlength=period)
        sizes = np.bincount(phases[free], minlength=period)
        for phase in np.flatnonzero(recurring(counted, sizes, n)):
            there = (phases == phase) & free
            middle = _median(rest[there])
            hits = int((out & there & (np.sign(rest) == np.sign(middle))).sum())
            if hits >= 3 and hits >= 0.65 * sizes[phase] and abs(middle) > STEP * scale:
                covered = hits / max(1, len(standing))
                if best is None or covered > best[0] + 1e-9:
                    best = (covered, there, middle)
    if best is None or best[0] < 0.4:
        return x
    flat = x.copy()
    flat[best[1]] -= best[2]
    return flat


def edges(y: np.ndarray, scale: float) -> np.ndarray:
    """Readings at which a step far outside the scatter ends, and the first one."""
    found = np.zeros(len(y), bool)
    for reach in RESOLUTIONS:
        size = np.abs(details(y, reach))
        edge_here = size > STEP * scale / np.sqrt(reach)
        if reach > 1:  # a coarser detail also rises beside an edge: only its peaks count
            beside = np.pad(size, 1)
            edge_here &= (size >= beside[:-2]) & (size >= beside[2:])
        found |= edge_here
    found[0] = True
    return found


def excursions(y: np.ndarray, at_edge: np.ndarray, fixed: np.ndarray, scale: float, opens: np.ndarray | None = None) -> np.ndarray:
    """Readings of excursions that begin and end at an edge; opens: the edges at which one may begin, all if not given."""
    n = len(y)
    opening = np.flatnonzero(at_edge if opens is None else opens).tolist()
    edge, held, taken, sticking = at_edge.tolist(), y.tolist(), [False] * n, fixed.tolist()
    # found readings are no background for others: the strongest come first, and the ends last
    for limit, ends in ((4 * SPIKE, False), (2 * SPIKE, False), (SPIKE, False), (SPIKE, True)):
        for a in opening:
            for width in range(WIDEST, 0, -1):
                b = a + width
                if b > n or all(taken[a:b]) or any(sticking[a:b]):
                    continue
                if (b == n or edge[b]) and _departure(held, a, b, taken, ends) > limit * scale:
                    taken[a:b] = [True] * width
                    break
    return np.array(taken, bool)


def spikes(x: np.ndarray, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Readings of excursions of at most WIDEST readings, up or down, far outside the scatter; at: their positions."""
    if len(x) < LEAST_READINGS:
        return np.zeros(len(x), bool)
    rough = _scale(x, fixed)
    quantum = _quantum(x)
    least = max(quantum / 4, 1e-9)
    y = without_recurrence(x, at, fixed, max(rough, least), least)
    scale = max(_scale(y, fixed), quantum / 3, 1e-6 * _median(np.abs(y)), 1e-300)
    return excursions(y, edges(y, scale), fixed, scale)


IMPOSSIBLE, STUCK, SPIKE_FOUND = 1, 2, 3


def judge(x: np.ndarray, impossible: np.ndarray) -> np.ndarray:
    """0, IMPOSSIBLE, STUCK or SPIKE_FOUND for each reading of a source in order; NaN stands for null and is 0."""
    code = np.zeros(len(x), np.int8)
    code[impossible] = IMPOSSIBLE
    at = np.flatnonzero(~np.isnan(x) & ~impossible)
    kept = x[at]
    if len(kept) == 0 or (kept == kept[0]).all():
        return code
    fixed = stuck(kept)
    code[at[fixed]] = STUCK
    code[at[spikes(kept, at, fixed)]] = SPIKE_FOUND
    return code


def _judge_sources(schema: pa.Schema):
    """Over rows (source, order, id, value, impossible), sorted by the first three, whole sources at a time."""
    kinds = np.array(["", "impossible", "stuck", "spike"])

    def answer(table: pa.Table, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("_id").to_numpy()
        values = table.column("_value").to_numpy()
        flags = table.column("_impossible").to_numpy()
        places, codes = [], []
        for a, b in zip(borders, borders[1:], strict=False):
            first = np.ones(b - a, bool)
            first[1:] = ids[a + 1 : b] != ids[a : b - 1]  # copies of a reading stand next to each other
            there = np.arange(a, b)[first]
            code = judge(values[there], flags[there])
            hit = np.flatnonzero(code > 0)
            places.append(there[hit])
            codes.append(code[hit])
        if places and len(place := np.concatenate(places)):
            source = table.column("_source").take(pa.array(place)).combine_chunks()
            yield pa.RecordBatch.from_arrays([source, pa.array(ids[place]), pa.array(kinds[np.concatenate(codes)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def borders(table: pa.Table) -> np.ndarray:
            key = table.column("_source").combine_chunks().dictionary_encode()
            source = key.indices.to_numpy() if isinstance(key, pa.DictionaryArray) else key.combine_chunks().indices.to_numpy()
            return np.concatenate([[0], np.flatnonzero(source[1:] != source[:-1]) + 1])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                starts = borders(table)
                if len(starts) > 1:
                    yield from answer(table, starts)
                    rest = table.slice(int(starts[-1]))
                    held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            yield from answer(table, np.append(borders(table), rows))

    return run


def implausible(readings: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, id, kind ('impossible', 'stuck' or 'spike') of each implausible reading.

    readings has source (string), order (long), id (long), value (double) and impossible (boolean: whether its quantity
    or unit rules the value out; null is no). A source is judged against its own readings in order, equal orders by id.
    A null or NaN value is no case, nor is a reading without source, order or id; infinities are impossible. Rows of
    one id and order count once. Sources that never change, and those of fewer than LEAST_READINGS readings apart from
    runs and bounds, show nothing. An empty table gives no rows; other columns are ignored.

    Sources of more than block rows are cut by position into pieces of at most that size, which are judged by the
    figures of their whole source (spikes_hot); the result is that of the uncut source. All others stay whole.
    """
    rows = readings.select(
        F.col("source").alias("_source"),
        F.col("order").cast("long").alias("_order"),
        F.col("id").cast("long").alias("_id"),
        F.col("value").cast("double").alias("_value"),
        (F.coalesce(F.col("impossible"), F.lit(False)) | F.col("value").cast("double").isin(float("inf"), float("-inf"))).alias("_impossible"),
    ).where("_source is not null and _order is not null and _id is not null")
    rows = rows.withColumn("_impossible", F.col("_impossible") & F.col("_value").isNotNull() & ~F.isnan("_value"))
    hot = [(r._source, r._n) for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).collect()]  # one of block rows
    whole = rows
    if hot:
        names = rows.sparkSession.createDataFrame([(s,) for s, _ in hot], "_source string")
        whole = rows.join(names, "_source", "left_anti")
    order = ["_source", "_order", "_id"]
    ready = whole.select(*order, "_value", "_impossible").repartition("_source").sortWithinPartitions(*order)
    schema = StructType([StructField("source", StringType()), StructField("id", LongType()), StructField("kind", StringType())])
    found = ready.mapInArrow(_judge_sources(to_arrow_schema(schema)), schema)
    if not hot:
        return found
    from chronoloom.operators.spikes_hot import judge_hot

    return found.unionByName(judge_hot(rows.join(names, "_source", "left_semi"), sum(n for _, n in hot), block))
