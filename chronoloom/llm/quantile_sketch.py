"""Percentiles of very large numeric columns from dyadic Count-sketches that add, subtract and combine.

A number becomes a 32-bit code that keeps its order. Each of the 32 binary resolutions of the code has one signed
sketch (ROWS x WIDTH counters, or exact counters where that resolution has no more than WIDTH cells); a rank is
inverted by descending from the coarsest resolution. The sketch is linear: partial results of partitions or days are
merged by addition, and negative weights delete. Until a sketch holds SPARSE distinct codes it travels as these codes and
their counts, which are shorter than its counters; the counters are made from them where ranks are asked for, for many
sketches at a time, so every percentile is read off the sketch and none depends on how the sketch travelled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

BITS = 32
WIDTH = 1024
ROWS = 5
SPARSE = 512
VALUE_ERROR = 2.0**-20
BLOCK_ROWS = 500_000

_EXACT_FROM = BITS - WIDTH.bit_length() + 1  # the first level with at most WIDTH cells
_RANDOM = np.random.default_rng(20240229)
_MULTIPLY = _RANDOM.integers(1, 2**62, (_EXACT_FROM, ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, (_EXACT_FROM, ROWS, 1), dtype=np.uint64)
_BASE = (np.arange(_EXACT_FROM * ROWS, dtype=np.int64) * WIDTH).reshape(_EXACT_FROM, ROWS, 1)
_SHIFT = np.uint64(64 - WIDTH.bit_length())  # the upper bits choose a counter, the one below them a sign
_LEVELS = np.arange(_EXACT_FROM, dtype=np.uint64).reshape(-1, 1)
#: How many standard errors the bound is wide, and the standard error of the median of five estimates for each unit that
#: the second and the fourth of them lie apart: normal approximation, 0.56 of their scatter, which is 1.01 of that distance.
SIGMAS = 3.0
_MEDIAN_ERROR = 0.56 * 1.01
_AT_ONCE = 256


def encode(values: np.ndarray) -> np.ndarray:
    """Codes in the order of the values: the upper half of the double's bits, so a relative step of 2^-20."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return ((bits ^ ((bits >> 63) | np.int64(-(2**63)))).view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def decode(codes: np.ndarray) -> np.ndarray:
    """The value of each code nearest to zero; whole numbers and fractions whose lower bits are zero come back exactly."""
    upper = codes.astype(np.uint64) << np.uint64(32)
    positive = upper >= np.uint64(2**63)
    return np.where(positive, upper ^ np.uint64(2**63), ~(upper | np.uint64(2**32 - 1))).view(np.float64)


class DyadicSketch:
    """A signed multiset of codes. Sparse: codes and counts; dense: counters per level."""

    __slots__ = ("codes", "counts", "dense", "exact", "n")

    def __init__(self) -> None:
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.dense: np.ndarray | None = None
        self.exact: np.ndarray | None = None
        self.n = 0

    @staticmethod
    def of(codes: np.ndarray, counts: np.ndarray) -> DyadicSketch:
        """From distinct, sorted codes and their counts."""
        made = DyadicSketch()
        made.codes, made.counts, made.n = codes, counts, int(counts.sum())
        if len(codes) > SPARSE:
            made._widen()
        return made

    def _widen(self) -> None:
        self.dense = np.zeros((_EXACT_FROM, ROWS, WIDTH), np.int64)
        self.exact = np.zeros(2 * WIDTH, np.int64)
        self._count(self.codes, self.counts)
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _count(self, codes: np.ndarray, counts: np.ndarray) -> None:
        flat = self.dense.reshape(-1)
        for part in range(0, len(codes), 65_536):
            some, weight = codes[part : part + 65_536].astype(np.uint64), counts[part : part + 65_536]
            mixed = ((some >> _LEVELS)[:, None, :] * _MULTIPLY + _ADD) >> _SHIFT
            signed = ((mixed & np.uint64(1)).astype(np.int64) * 2 - 1) * weight
            cells = (mixed >> np.uint64(1)).astype(np.int64) + _BASE
            flat += np.bincount(cells.ravel(), signed.ravel(), len(flat)).astype(np.int64)
            finest = np.bincount((some >> np.uint64(_EXACT_FROM)).astype(np.int64), weight, 1 << (BITS - _EXACT_FROM)).astype(np.int64)
            for level in range(_EXACT_FROM, BITS + 1):
                cells_there = 1 << (BITS - level)
                self.exact[cells_there : 2 * cells_there] += finest
                finest = finest.reshape(-1, 2).sum(axis=1) if len(finest) > 1 else finest

    def add(self, other: DyadicSketch) -> DyadicSketch:
        """Merge by addition."""
        self.n += other.n
        if self.dense is None and other.dense is None:
            codes, place = np.unique(np.concatenate([self.codes, other.codes]), return_inverse=True)
            counts = np.rint(np.bincount(place, np.concatenate([self.counts, other.counts]).astype(np.float64), len(codes))).astype(np.int64)
            self.codes, self.counts = codes[counts != 0], counts[counts != 0]
            if len(self.codes) > SPARSE:
                self._widen()
            return self
        if self.dense is None:
            self._widen()
        if other.dense is None:
            self._count(other.codes, other.counts)
        else:
            self.dense += other.dense
            self.exact += other.exact
        return self

    def negated(self) -> DyadicSketch:
        """The sketch whose addition deletes this one's values."""
        made = DyadicSketch.load(self.dump())
        made.n, made.counts = -made.n, -made.counts
        if made.dense is not None:
            made.dense, made.exact = -made.dense, -made.exact
        return made

    def quantiles(self, shares: Sequence[float]) -> list[float | None]:
        """The values at rank ceil(share * n); None where nothing is held."""
        return quantiles_of([self], shares)[0][0]

    def rank_error(self, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> float:
        """SIGMAS standard errors of the ranks found, as a share of n."""
        return quantiles_of([self], shares)[0][1]

    def dump(self) -> bytes:
        if self.dense is not None:
            return b"d" + zlib.compress(np.int64(self.n).tobytes() + self.exact.tobytes() + self.dense.tobytes(), 1)
        ones = bool((self.counts == 1).all())
        return (b"1" if ones else b"s") + self.codes.tobytes() + (b"" if ones else self.counts.tobytes())

    @staticmethod
    def load(data: bytes) -> DyadicSketch:
        made, kind = DyadicSketch(), data[:1]
        if kind == b"d":
            whole = np.frombuffer(bytearray(zlib.decompress(memoryview(data)[1:])), np.int64)
            made.n, made.exact = int(whole[0]), whole[1 : 1 + 2 * WIDTH]
            made.dense = whole[1 + 2 * WIDTH :].reshape(_EXACT_FROM, ROWS, WIDTH)
            return made
        held = (len(data) - 1) // (4 if kind == b"1" else 12)
        made.codes = np.frombuffer(data, np.uint32, held, 1)
        made.counts = np.ones(held, np.int64) if kind == b"1" else np.frombuffer(data, np.int64, held, 1 + 4 * held)
        made.n = int(made.counts.sum())
        return made


class _Level:
    """The counters of one resolution of many sketches, made from their codes or taken from them."""

    def __init__(self, sketches: list[DyadicSketch], level: int, owner: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        self.level, n = level, len(sketches)
        self.exact = level >= _EXACT_FROM
        cells = 1 << (BITS - level)
        if self.exact:
            self.held = np.bincount(owner * cells + (codes >> np.uint64(level)).astype(np.int64), counts, n * cells).reshape(n, cells)
        else:
            mixed = ((codes >> np.uint64(level)) * _MULTIPLY[level] + _ADD[level]) >> _SHIFT
            signed = ((mixed & np.uint64(1)).astype(np.int64) * 2 - 1) * counts
            at = (mixed >> np.uint64(1)).astype(np.int64) + owner * WIDTH
            self.held = np.stack([np.bincount(at[r], signed[r], n * WIDTH) for r in range(ROWS)]).reshape(ROWS, n, WIDTH)
        for i, sketch in enumerate(sketches):
            if sketch.dense is not None:
                if self.exact:
                    self.held[i] = sketch.exact[cells : 2 * cells]
                else:
                    self.held[:, i] = sketch.dense[level]

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """The estimate of each row of counters for nodes[sketch, k]; one row where the counters are exact."""
        which = np.arange(len(nodes))[:, None]
        if self.exact:
            return self.held[which, nodes][None]
        mixed = (nodes.astype(np.uint64)[None] * _MULTIPLY[self.level][:, :, None] + _ADD[self.level][:, :, None]) >> _SHIFT
        signs = (mixed & np.uint64(1)).astype(np.int64) * 2 - 1
        at = (mixed >> np.uint64(1)).astype(np.int64)
        return self.held[np.arange(ROWS)[:, None, None], which[None], at] * signs


def quantiles_of(sketches: list[DyadicSketch], shares: Sequence[float]) -> list[tuple[list[float | None], float]]:
    """For each sketch its values at ranks ceil(share * n) and the bound of the error of these ranks, a share of n.

    One descent for all of them: at each resolution a left child is estimated from both children and their parent, by the
    median of the rows. How far the rows of the nodes on the way lie apart tells the error of each step; the bound is SIGMAS
    times the root of the summed squares, for the worst of the shares. Nothing held, or less than nothing: None and 0.
    """
    made: list[tuple[list[float | None], float]] = [([None] * len(shares), 0.0)] * len(sketches)
    live = [i for i, s in enumerate(sketches) if s.n > 0]
    for part in range(0, len(live), _AT_ONCE):
        some = live[part : part + _AT_ONCE]
        held = [sketches[i] for i in some]
        sparse = [s if s.dense is None else _NOTHING for s in held]
        owner = np.repeat(np.arange(len(held)), [len(s.codes) for s in sparse])
        codes, counts = np.concatenate([s.codes for s in sparse]).astype(np.uint64), np.concatenate([s.counts for s in sparse])
        total = np.array([s.n for s in held], np.int64)
        ranks = np.stack([np.clip(np.ceil(np.round(q * total, 9)), 1, total) for q in shares], axis=1)
        node, inside, rest, variance = np.zeros(ranks.shape, np.int64), np.repeat(total[:, None].astype(float), len(shares), 1), ranks, np.zeros(ranks.shape)
        for level in range(BITS - 1, -1, -1):
            counters = _Level(held, level, owner, codes, counts)
            left = counters.rows(2 * node)
            if counters.exact:
                left = left[0]
            else:
                rows = np.sort((left + inside - counters.rows(2 * node + 1)) / 2, axis=0)
                # the middle rows only: one that met a frequent value by chance says nothing of the median's error
                variance += (_MEDIAN_ERROR * (rows[ROWS // 2 + 1] - rows[ROWS // 2 - 1])) ** 2
                left = np.clip(rows[ROWS // 2], 0, inside)
            goes = rest > left
            node = 2 * node + goes
            inside = np.where(goes, inside - left, left)
            rest = np.where(goes, rest - left, rest)
        values = decode(node.astype(np.uint32))
        errors = SIGMAS * np.sqrt(variance.max(axis=1)) / total
        for k, i in enumerate(some):
            made[i] = (values[k].tolist(), min(1.0, float(errors[k])))
    return made


_NOTHING = DyadicSketch()


def _sketch(keys: int, measures: Sequence[str], schema: pa.Schema):
    """Rows (keys..., measures...) in any order to rows (keys..., measure, sketch), some for each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names = whole.column_names
            # keys become small integers, so that any type and null can be a key
            place = np.zeros(whole.num_rows, np.int64)
            parts = [whole.column(i).combine_chunks().dictionary_encode("encode") for i in range(keys)]
            for part in parts:
                part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
                place = place * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
            _, first, group = np.unique(place, return_index=True, return_inverse=True)
            for at, measure in enumerate(measures, keys):
                column = whole.column(names[at]).combine_chunks()
                values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
                fits = ~np.isnan(values)
                both = group[fits].astype(np.uint64) << np.uint64(32) | encode(values[fits]).astype(np.uint64)
                cells, counts = np.unique(both, return_counts=True)
                owner, codes = (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(2**32 - 1)).astype(np.uint32)
                borders = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
                spans = [(a, b) for a, b in zip(borders, borders[1:], strict=False) if a < b]
                if not spans:
                    continue
                chosen = pa.array(first[[owner[a] for a, _ in spans]])
                blobs = [DyadicSketch.of(codes[a:b], counts[a:b]).dump() for a, b in spans]
                columns = [whole.column(i).take(chosen).combine_chunks() for i in range(keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([measure] * len(spans)), pa.array(blobs, pa.binary())], schema=schema)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from block()
                rows = 0
        if rows:
            yield from block()

    return run


def sketches(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Partial sketches keys..., measure, sketch of the numeric columns measures; merge() brings them to one per key.

    One pass over the rows where they lie, without a shuffle: what leaves a task is bounded by its groups. Null and NaN
    count in no sketch; infinities are values; a group without a value gives no sketch.
    """
    fields = [StructField(k, df.schema[k].dataType) for k in keys]
    schema = StructType([*fields, StructField("measure", StringType()), StructField("sketch", BinaryType())])
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{m}`").cast("double").alias(f"_m{i}") for i, m in enumerate(measures)])
    return rows.mapInArrow(_sketch(len(keys), list(measures), to_arrow_schema(schema)), schema)


def _over_groups(finish, schema: pa.Schema):
    """Add up the sketches of each run of equal keys in rows (keys..., sketch) and hand the sums, many at a time, to finish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, keys, sums = None, None, [], []

        def flush() -> pa.RecordBatch:
            rows = [(*key, *made) for key, made in zip(keys, finish(sums), strict=True)]
            keys.clear()
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for *key, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    if current is not None:
                        keys.append(current)
                        sums.append(total)
                        if len(sums) >= _AT_ONCE:
                            yield flush()
                    current, total = key, DyadicSketch.load(blob)
                else:
                    total.add(DyadicSketch.load(blob))
        if current is not None:
            keys.append(current)
            sums.append(total)
            yield flush()

    return run


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch keys..., measure, sketch for each key and measure; further columns, such as the day, are summed over."""
    by = [*keys, "measure"]
    schema = StructType([*[StructField(k, parts.schema[k].dataType) for k in by], StructField("sketch", BinaryType())])
    rows = parts.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(_over_groups(lambda sums: [(s.dump(),) for s in sums], to_arrow_schema(schema)), schema)


def percentiles(parts: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys..., measure, n, one column p<percent> for each share, rank_error and value_error, from any partial sketches.

    A percentile is the value at rank ceil(share * n), found with a rank wrong by at most rank_error * n and a value wrong
    by at most value_error times itself. rank_error is SIGMAS standard errors by the spread of the sketch's own rows, so it
    holds for about 99 of 100 groups and is 0 where no rows of counters disagree. Groups from which everything was
    deleted have n 0 and null percentiles.
    """
    by = [*keys, "measure"]
    names = [f"p{round(q * 100, 6):g}".replace(".", "_") for q in shares]
    fields = [*[StructField(k, parts.schema[k].dataType) for k in by], StructField("n", LongType())]
    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in names], StructField("rank_error", DoubleType())])
    asked = list(shares)
    rows = parts.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by)
    answer = lambda sums: [(s.n, *values, error) for s, (values, error) in zip(sums, quantiles_of(sums, asked), strict=True)]
    found = rows.mapInArrow(_over_groups(answer, to_arrow_schema(schema)), schema)
    return found.withColumn("value_error", F.lit(VALUE_ERROR))
