"""Precision and recall of implausible readings on planted cases in sources of every kind of normal behaviour."""

import numpy as np

from chronoloom.operators.spikes import edges, judge


def source(rng, kind, n):
    x = rng.normal(0, 1, n)
    if kind == "drift":
        x = x + np.arange(n) * 0.2
    elif kind == "levels":
        x = x + np.repeat(rng.permutation(4) * 12.0, -(-n // 4))[:n]
    elif kind == "recurring":
        x[rng.integers(0, 6) :: 6] += 14
    elif kind == "coarse":
        x = np.round(x * 1.5) / 1.5
    elif kind == "skewed":
        x = rng.gamma(6, 0.4, n)
    return x * 3 + 40


def planted(rng, kind, n):
    """Readings of a source and the places of the cases put into it."""
    x, true, flags = source(rng, kind, n), set(), np.zeros(n, bool)
    places = rng.permutation(np.arange(12, n - 30, 26))
    for at in places[: max(1, n // 60)]:
        what = rng.choice(["spike", "spike", "stuck", "impossible"])
        if what == "spike":
            width = int(rng.integers(1, 4))
            x[at : at + width] += rng.choice([-1, 1]) * rng.uniform(60, 120) * (1 + 0.1 * rng.random(width))
            true |= set(range(at, at + width))
        elif what == "stuck":
            length = int(rng.integers(16, 22)) if kind == "coarse" else int(rng.integers(10, 16))
            x[at : at + length] = x[at]
            true |= set(range(at, at + length))
        else:
            x[at], flags[at] = -1e6, True
            true.add(int(at))
    for at in sorted(true):  # a reading beside a stuck run that happens to be equal belongs to it
        for step in (-1, 1):
            to = at + step
            while 0 <= to < n and to not in true and x[to] == x[at] and not flags[at]:
                true.add(int(to))
                to += step
    return x, flags, true


def test_recall_and_precision_on_planted_cases():
    rng = np.random.default_rng(17)
    for kind in ("noise", "drift", "levels", "recurring", "coarse", "skewed"):
        both = every = found = 0
        for _ in range(40):
            x, flags, true = planted(rng, kind, int(rng.integers(120, 400)))
            got = set(np.flatnonzero(judge(x, flags)).tolist())
            both, every, found = both + len(got & true), every + len(true), found + len(got)
        assert both >= 0.99 * every and both >= 0.99 * found, (kind, both, every, found)


def test_scaled_details_alone_cannot_decide():
    """A lasting change has as large a detail as a spike: what tells them apart is the way back, which no detail shows."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(80, 1, 60)])
    x[30] += 80
    at = set(np.flatnonzero(edges(x, 1.0)).tolist())
    assert {30, 31, 60} <= at  # all three stand out alike
    assert np.flatnonzero(judge(x, np.zeros(120, bool))).tolist() == [30]
