import math
import random

import numpy as np
import pytest

from chronoloom.llm.nearest_time import LearnedIndex, nearest
from chronoloom.llm.packing import FirstFit, pack
from chronoloom.llm.quantile_sketch import DyadicSketch, decode, encode, merge, percentiles, quantiles_of, sketches
from chronoloom.llm.top_n import top_n


def test_learned_index_is_searchsorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        for keys in (np.cumsum(rng.integers(1, 50, n)), np.cumsum(rng.integers(1, 2, n) ** 3), np.unique(rng.zipf(1.3, n).astype(np.int64) % 10**15), np.cumsum(rng.integers(1, 3, n)) + 4 * 10**16):
            asked = np.concatenate([keys, keys - 1, keys + 1, rng.integers(keys[0] - 5, keys[-1] + 5, 200)])
            assert (LearnedIndex(keys).first_at_least(asked) == np.searchsorted(keys, asked)).all()


LEFT = "cap long, tid int, scale long, ticks long, id long, extra string"


def brute_nearest(left, right, tolerance):
    out = set()
    for cap, tid, scale, us, rid, _ in right:
        best = None
        for c, t, s, ticks, lid, _ in left:
            if None in (cap, tid, us, c, t, ticks) or (c, t) != (cap, tid) or s != scale:
                continue
            d = abs(us * s - ticks * 10**6)
            if d <= tolerance * s:
                best = min(best or (d, ticks, lid), (d, ticks, lid))
        if best:
            out.add((best[2], rid))
    return out


def test_nearest_matches_brute_force(spark):
    rng = random.Random(2)
    for scale in (1_000_000, 19_200_000, 3, 10_000_000_000):
        top = 60 * scale
        left = [(rng.choice([1, 1, 1, 2, None]), rng.choice([2, 3]), scale, rng.choice([rng.randrange(top), rng.randrange(60) * scale, None] if i % 9 == 0 else [rng.randrange(top)]), i, "x") for i in range(300)]
        right = [(rng.choice([1, 1, 2]), rng.choice([2, 3, None]), scale, rng.choice([rng.randrange(60_000_000), rng.randrange(60) * 10**6]), 10_000 + i, "y") for i in range(200)]
        left, right = left + left[:30], right + right[:30]
        for tolerance, seconds in ((3_000, 1), (400_000, 7), (0, 10)):
            got = nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT), ["cap", "tid"], tolerance, seconds)
            assert {tuple(r) for r in got.collect()} == brute_nearest(left, right, tolerance)


def test_nearest_of_nothing_and_bad_scales(spark):
    one = spark.createDataFrame([(1, 1, 0, 5, 1, ""), (1, 1, 10**13, 5, 2, ""), (1, 1, None, 5, 3, "")], LEFT)
    none = spark.createDataFrame([], LEFT)
    assert nearest(one, one, ["cap", "tid"], 5).count() == 0 and nearest(none, one, ["cap", "tid"], 5).count() == 0


def test_nearest_widens_its_shards_to_the_tolerance(spark):
    left = [(1, 1, 1000, 5_000 * i, i, "") for i in range(20)]
    right = [(1, 1, 1000, 7_000_000 * i + 3, 100 + i, "") for i in range(14)]
    got = nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT), ["cap", "tid"], 60_000_000)
    assert {tuple(r) for r in got.collect()} == brute_nearest(left, right, 60_000_000)
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT), ["cap", "tid"], 10**13)


def test_codes_keep_order_and_value():
    x = np.array([-np.inf, -1e300, -3.25, -1e-9, -0.0, 0.0, 1e-9, 1.5, 16.667, 1e10, np.inf])
    assert (np.diff(encode(x).astype(np.int64)) >= 0).all()
    back = decode(encode(x))
    finite = np.isfinite(x)
    assert (np.abs(back[finite] - x[finite]) <= 2.0**-20 * np.abs(x[finite])).all() and back[0] == -np.inf and back[-1] == np.inf


def sketch_of(x):
    return DyadicSketch.of(*np.unique(encode(np.asarray(x, float)), return_counts=True))


@pytest.mark.parametrize("n", [1, 100, 900, 20_000])
def test_ranks_merge_and_deletion(n):
    x = np.random.default_rng(n).lognormal(3, 0.5, n)
    halves = sketch_of(x[: n // 2]).add(sketch_of(x[n // 2 :]))
    whole = sketch_of(x)
    shares = (0.01, 0.5, 0.95, 0.99)
    assert halves.quantiles(shares) == whole.quantiles(shares) and DyadicSketch.load(whole.dump()).quantiles(shares) == whole.quantiles(shares)
    order = np.sort(x)
    for q, value in zip(shares, whole.quantiles(shares)):
        low, high = np.searchsorted(order, value * (1 - 2e-6)), np.searchsorted(order, value * (1 + 2e-6), "right")
        rank = math.ceil(q * n)
        assert low - whole.rank_error() * n - 1 <= rank <= high + whole.rank_error() * n + 1
    # however it travels, a sketch says the same
    counters = sketch_of(x)
    if counters.dense is None:
        counters._widen()
    assert counters.quantiles(shares) == whole.quantiles(shares) and counters.rank_error() == whole.rank_error() <= 0.05 + 1 / n
    gone = whole.add(sketch_of(x[n // 2 :]).negated())
    assert gone.n == n // 2 and (n < 2 or abs(np.searchsorted(np.sort(x[: n // 2]), gone.quantiles([0.5])[0]) / (n // 2) - 0.5) < 0.05)


def test_rank_errors_keep_their_bound():
    rng, shares, beyond = np.random.default_rng(9), (0.5, 0.95, 0.99), 0
    for i in range(60):
        n = int(rng.integers(200, 20_000))
        x = np.sort(rng.choice([rng.lognormal(3, 1, n), rng.normal(0, 5, n), rng.integers(0, 10**9, n).astype(float)]))
        (values, error), = quantiles_of([sketch_of(x)], shares)
        assert error < 0.06
        for q, v in zip(shares, values):
            low, high = np.searchsorted(x, v - abs(v) * 2.0**-19), np.searchsorted(x, v + abs(v) * 2.0**-19, "right")
            beyond += not low - error * n - 1 <= math.ceil(q * n) <= high + error * n + 1
    assert beyond <= 4


def test_percentiles_by_group_from_days(spark):
    rng = np.random.default_rng(3)
    rows = [(k, d, None if i % 50 == 0 else float(v), float("nan") if i % 60 == 0 else float(i)) for k in ("a", None) for d in (1, 2, 3) for i, v in enumerate(rng.normal(100, 5, 400))]
    df = spark.createDataFrame(rows, "k string, day int, x double, y double").repartition(5)
    parts = merge(sketches(df, ["k", "day"], ["x", "y"]), ["k", "day"])
    got = {(r.k, r.measure): r for r in percentiles(parts, ["k"], (0.5, 0.99)).collect()}
    assert len(got) == 4
    for (k, _), r in got.items():
        values = sorted(v for g, _, x, y in rows if g == k for v in [x if r.measure == "_" or "x" in r.measure else y] if v is not None and v == v)
        assert r.n == len(values) and abs(np.searchsorted(values, r.p50) / r.n - 0.5) <= r.rank_error + 0.002
    assert sketches(df.limit(0), ["k"], ["x"]).count() == 0


TOP = "g long, score double, item long, g2 string, rank string"


def brute_top(rows, n):
    kept = {(g, s + 0.0, i) for g, s, i, *_ in rows if g is not None and i is not None and s is not None and s == s}
    out = set()
    for g in {g for g, _, _ in kept}:
        order = sorted((-s, i) for gg, s, i in kept if gg == g)
        out |= {(g, i, k + 1) for k, (_, i) in enumerate(order[:n])}
    return out


def test_top_n_matches_brute_force(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, 2.5, 2.5, -3.0, None, float("nan"), float("inf")]
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice(values) if rng.random() < 0.5 else rng.random() * 4, rng.choice([None, *range(60)]), "x", "y") for _ in range(900)]
    rows += rows[:200] + [(99, 1.0, 5, "", "")]
    df = spark.createDataFrame(rows, TOP).repartition(6)
    for n, fractions in ((3, (0.75, 0.45)), (1, (0.9,)), (50, ()), (3, (0.99, 0.98, 0.5, 0.01))):
        assert {(r.g, r.item, r["rank"]) for r in top_n(df, ["g"], "score", "item", n, fractions).collect()} == brute_top(rows, n)
    assert top_n(df.limit(0), ["g"], "score", "item", 3).count() == 0
    assert {(r.g, r.g2, r.item) for r in top_n(df, ["g", "g2"], "score", "item", 3).collect()} == {(g, "" if g == 99 else "x", i) for g, i, _ in brute_top(rows, 3)}
    assert {(r.g, r.g2, r.item) for r in top_n(df.withColumnRenamed("item", "_item"), ["g", "g2"], "score", "_item", 3).withColumnRenamed("_item", "item").collect()} == {(g, "" if g == 99 else "x", i) for g, i, _ in brute_top(rows, 3)}


def test_first_fit_is_first_fit():
    rng = random.Random(11)
    for _ in range(30):
        sizes = sorted((rng.randrange(0, 101) for _ in range(rng.randrange(1, 120))), reverse=True)
        tree, room = FirstFit(100), []
        for size in sizes:
            at = next((i for i, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= size
            assert tree.place(size) == at


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, None, rng.randrange(1, 400), rng.randrange(1, 50), 1000, 2500, -4]), "clash") for i in range(3000)] + [(5, 70, ""), (5, 70, ""), (None, 30, "")]
    df = spark.createDataFrame(rows, "id long, size long, container string").repartition(5)
    out = pack(df, "id", "size", 1000, group_items=700).collect()
    fill, parts = {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.size
        parts.setdefault(r.id, []).append((r.first, r.size))
    assert max(fill.values()) <= 1000
    want = {}
    for i, size, _ in rows:
        want[i] = want.get(i, 0) + max(size or 0, 0)
    assert {i: sum(s for _, s in p) for i, p in parts.items()} == want
    assert len(out) == sum(max(1, -(-max(s or 0, 0) // 1000)) for _, s, _ in rows)
    assert len(fill) <= sum(want.values()) / 1000 * 1.02 + 6
    assert pack(df.limit(0), "id", "size", 1000).count() == 0
