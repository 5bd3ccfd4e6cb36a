"""Sources above the block size give what the uncut source gives."""

from collections import Counter

import numpy as np

from chronoloom.operators.spikes import implausible, judge

KINDS = {1: "impossible", 2: "stuck", 3: "spike"}


def test_pieces_are_judged_as_their_whole_source(spark):
    n, r = 3000, np.random.default_rng(5)
    at = np.arange(n) * 3
    noise = lambda: r.normal(20, 0.3, n).round(3)
    sources = {}
    x = noise()
    x[800:2450] = 7.0  # holds whole pieces
    sources["stuck"] = (x, at)
    x = noise()
    x[[700, 701, 2500]] -= 9
    stray = at.copy()
    stray[[0, -1]] = -(10**12), 10**15
    sources["stray order"] = (x, stray)
    x = np.full(n, np.nan)
    x[::300] = r.normal(5, 1, 10)
    x[1500] = 90  # one reading in most pieces
    sources["thin"] = (x, at)
    x = noise()
    x[4::6] += 9
    x[[20, 2000]] += 30
    sources["recurrence"] = (x, at)
    x = r.standard_t(1.5, n)
    x[[499, 500, 501, 999, 1000]] += 500
    sources["heavy tails"] = (x, at)
    sources["constant"] = (np.full(n, 7.0), at)
    rows, want = [], set()
    for name, (x, order) in sources.items():
        rows += [(name, int(o), i, None if np.isnan(v) else float(v), False) for i, (o, v) in enumerate(zip(order, x, strict=True))]
        codes = judge(x, np.zeros(n, bool))
        want |= {(name, int(i), KINDS[int(codes[i])]) for i in np.flatnonzero(codes)}
    df = spark.createDataFrame(rows, "source string, order long, id long, value double, impossible boolean")
    got = [tuple(r) for r in implausible(df, block=400).collect()]
    assert Counter(got) == Counter(want)
    assert sum(k == "stuck" for _, _, k in got) == 1650 and ("thin", 1500, "spike") in want
