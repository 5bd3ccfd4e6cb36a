import random

from chronoloom.operators.interval_map import IntervalMap, periods_and_gaps

SCHEMA = "k long, kind string, b long, e long, what string"


def brute(spans):
    out = {}
    for k, kind, b, e in spans:
        if b is not None and e is not None and e > b:
            out.setdefault((k, kind), set()).update(range(b, e))
    rows = set()
    for key, points in out.items():
        order = sorted(points)
        periods, start = [], order[0]
        for x, y in zip(order, [*order[1:], None]):
            if y is None or y != x + 1:
                periods.append((start, x + 1))
                start = y
        rows |= {(*key, "period", b, e) for b, e in periods}
        rows |= {(*key, "gap", e, b) for (_, e), (b, _) in zip(periods, periods[1:])}
    return rows


def test_map_inserts_in_any_order():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(b := rng.randrange(60), b + rng.randrange(-1, 9)) for _ in range(rng.randrange(12))]
        held = IntervalMap()
        for b, e in spans:
            held.insert(b, e)
        want = brute([(1, "x", b, e) for b, e in spans])
        assert {(1, "x", "period", *p) for p in held.periods()} | {(1, "x", "gap", *g) for g in held.gaps()} == want


def test_periods_and_gaps_match_brute_force(spark):
    rng = random.Random(5)
    spans = []
    for _ in range(600):
        b = rng.randrange(900)
        spans.append((rng.choice([1, 1, 1, 2, None]), rng.choice(["work", "wait", None]), rng.choice([b, b, b, None]), b + rng.randrange(-3, 40)))
    spans += spans[:50] + [(2, "work", 0, 700)]
    df = spark.createDataFrame([(*s, "clash") for s in spans], SCHEMA)
    for shard, hot in ((7, 10**6), (64, 5), (10_000, 10**6)):
        got = {tuple(r) for r in periods_and_gaps(df, ["k", "kind"], "b", "e", shard, hot).collect()}
        assert got == brute(spans)


def test_one_endless_span_costs_no_more_than_another(spark):
    spans = [(1, "x", 5, 2**62, ""), (1, "x", 1, 3, ""), (1, "x", 4000, 4100, ""), (1, "x", 2**62 + 9, 2**62 + 11, ""), (None, "y", -(2**61), -7, ""), (None, "y", -6, 40, ""), (2, "x", 1, 30, ""), (2, "x", 31, 33, "")]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(spans, SCHEMA), ["k", "kind"], "b", "e", 10).collect()}
    assert got == {
        (1, "x", "period", 1, 3), (1, "x", "gap", 3, 5), (1, "x", "period", 5, 2**62), (1, "x", "gap", 2**62, 2**62 + 9), (1, "x", "period", 2**62 + 9, 2**62 + 11),
        (None, "y", "period", -(2**61), -7), (None, "y", "gap", -7, -6), (None, "y", "period", -6, 40), (2, "x", "period", 1, 30), (2, "x", "gap", 30, 31), (2, "x", "period", 31, 33),
    }


def test_gap_columns_empty_and_negative(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(df, ["k", "kind"], "b", "e").count() == 0
    df = spark.createDataFrame([(1, "x", -30, -10, ""), (1, "x", -10, 5, ""), (1, "x", 9, 12, "")], SCHEMA)
    got = sorted((r.what, r.b, r.e) for r in periods_and_gaps(df, ["k", "kind"], "b", "e", 8).collect())
    assert got == [("gap", 5, 9), ("period", -30, 5), ("period", 9, 12)]
