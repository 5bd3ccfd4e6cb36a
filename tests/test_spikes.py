import numpy as np

from chronoloom.operators.spikes import IMPOSSIBLE, SPIKE_FOUND, STUCK, implausible, judge, stuck


def codes(x, impossible=()):
    flags = np.zeros(len(x), bool)
    flags[list(impossible)] = True
    return judge(np.array(x, float), flags)


def noise(n, seed=0, level=20.0, sd=0.3):
    return np.round(np.random.default_rng(seed).normal(level, sd, n), 3)


def test_brief_excursions_up_and_down():
    x = noise(60)
    x[10] = 35
    x[30:33] = [9, 9.3, 9.6]
    assert np.flatnonzero(codes(x) == SPIKE_FOUND).tolist() == [10, 30, 31, 32]


def test_ends_count_too():
    x = noise(50)
    x[0], x[-2:] = 40, [31, 30]
    assert np.flatnonzero(codes(x)).tolist() == [0, 48, 49]


def test_normal_behaviour_is_left_alone():
    steps = np.concatenate([noise(30, 1, 10), noise(30, 2, 18)])
    drift = noise(60, 3) + np.arange(60) * 0.4
    again = noise(60, 4)
    again[4::6] += 9
    coarse = np.round(noise(60, 5, 20, 1.2) / 0.5) * 0.5
    for x in (steps, drift, again, coarse, np.full(40, 7.0), noise(5)):
        assert not codes(x).any()


def test_spike_within_a_recurrence():
    x = noise(60, 6)
    x[4::6] += 9
    x[20] += 30
    assert np.flatnonzero(codes(x)).tolist() == [20]


def test_stuck_runs_and_nulls():
    x = noise(50, 7)
    x[20:29] = x[19]
    x[24] = np.nan
    c = codes(x)
    assert np.flatnonzero(c == STUCK).tolist() == [19, 20, 21, 22, 23, 25, 26, 27, 28] and c[24] == 0
    assert not stuck(np.array([1, 1, 1, 2, 2, 2, 1, 1, 1, 2, 2, 2, 3, 3, 3], float)).any()


def test_impossible_readings_do_not_move_the_rest():
    x = noise(40, 8)
    x[5], x[6] = -50, 4e9
    assert codes(x, [5, 6])[5:7].tolist() == [IMPOSSIBLE] * 2 and (codes(x, [5, 6]) > 0).sum() == 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, order long, id long, value double, impossible boolean, kind string")


def test_operator_edge_cases(spark):
    x = noise(60, 9)
    x[33] = 90
    rows = [("a", i, 100 + i, float(v), False, "k") for i, v in enumerate(x)]
    rows += rows[:20] + [("a", None, 1, 1.0, False, ""), (None, 1, 2, 1.0, True, ""), ("b", 1, 7, float("inf"), None, ""), ("b", 2, 8, None, True, ""), ("b", 3, 9, float("nan"), True, "")]
    got = {tuple(r) for r in implausible(frame(spark, rows)).collect()}
    assert got == {("a", 133, "spike"), ("b", 7, "impossible")}
    assert implausible(frame(spark, [])).count() == 0


def test_hot_source_in_blocks_finds_the_same(spark):
    x = noise(3000, 10)
    x[[50, 499, 500, 1500]] += 40
    x[1990:2010] = x[1990]
    rows = [("hot", i * 3, i, float(v), False, "") for i, v in enumerate(x)]
    whole = {tuple(r) for r in implausible(frame(spark, rows)).collect()}
    blocks = {tuple(r) for r in implausible(frame(spark, rows), block=500).collect()}
    assert whole == blocks and {i for _, i, k in whole if k == "spike"} == {50, 499, 500, 1500}
