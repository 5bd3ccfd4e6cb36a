import math
import random
import time

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars
from chronoloom.operators import asof, calltree, dist, graph, intervals, pairing
from chronoloom.operators.records import latest_delivery


def test_latest_delivery_is_independent_of_partitions(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (None, 1, "d"), (2, None, "e"), (2, 0, "f")]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k long, v long, x string").repartition(n)
        assert {(r.k, r.x) for r in latest_delivery(df, ["k"], "v").collect()} == {(1, "c"), (None, "d"), (2, "f")}


def spans(rng, n=120):
    return [(rng.randrange(3), b := rng.randrange(200), b + rng.randrange(-2, 30), i) for i in range(n)]


def test_interval_algebra_matches_points(spark):
    rng = random.Random(1)
    own, other = spans(rng), spans(rng, 60)
    a, b = (spark.createDataFrame(x, "k int, b long, e long, id int") for x in (own, other))
    points = lambda rows, k: [p for kk, lo, hi, _ in rows if kk == k for p in range(lo, hi)]
    covered = {r.k: r.covered for r in intervals.union_length(a, ["k"]).collect()}
    swept = {r.k: r for r in intervals.sweep(a, ["k"]).collect()}
    left = {r.k: r.n for r in intervals.difference(a, b, ["k"]).groupBy("k").agg(F.sum(F.col("e") - F.col("b")).alias("n")).collect()}
    for k in range(3):
        mine = points(own, k)
        assert covered[k] == len(set(mine)) == swept[k].covered
        assert swept[k].peak == max(map(mine.count, set(mine))) and swept[k].contended == sum(mine.count(p) > 1 for p in set(mine))
        assert left.get(k, 0) == len(set(mine) - set(points(other, k)))


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_is_the_theta_join(spark, seed):
    rng = random.Random(seed)
    a = [(k, b - 50, e - 50, i) for k, b, e, i in spans(rng)] + [(0, -5, 2**61, 900), (1, -(2**40), 7, 901), (2, 3, 4, 902)]
    b = [(k, b - 50, e - 50, 1000 + i) for k, b, e, i in spans(rng, 50)] + [(0, -(2**61), 2**62, 1900)]
    left = spark.createDataFrame(a, "k int, b long, e long, id int")
    right = spark.createDataFrame(b, "k int, b long, e long, other int")
    got = sorted((r.id, r.other) for r in intervals.overlap_join(left, right, ["k"]).collect())
    assert got == sorted((i, j) for k, lo, hi, i in a for kk, lo2, hi2, j in b if k == kk and lo < hi and lo2 < hi2 and lo < hi2 and lo2 < hi)
    assert intervals.overlap_join(left, right.where("false"), ["k"]).count() == 0


def test_hot_keys_give_what_whole_keys_give(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.8 else rng.choice([2, None]), s, s // 2, rng.choice([1, 1, -1])) for s in range(400)]
    df = spark.createDataFrame(rows, "tid int, seq long, cycle long, d int")
    key = lambda df: sorted(map(str, df.collect()))
    for pair in (pairing.stack_pairs, pairing.queue_pairs, pairing.last_begin_pairs, pairing.pairing_counts):
        assert key(pair(df, ["tid"], hot=40)) == key(pair(df, ["tid"])), pair
    pairs = pairing.stack_pairs(df, ["tid"])
    assert key(pairing.with_parent(pairs, ["tid"], hot=20)) == key(pairing.with_parent(pairs, ["tid"]))
    spans_ = df.select("tid", F.col("cycle").alias("b"), (F.col("cycle") + F.pmod(F.col("seq") * 7, F.lit(5))).alias("e"), "d")
    assert key(intervals.merged(spans_, ["tid"], hot=30)) == key(intervals.merged(spans_, ["tid"]))
    assert key(intervals.segments(spans_, ["tid"], {"n": F.lit(1), "d": F.col("d")}, hot=30)) == key(intervals.segments(spans_, ["tid"], {"n": F.lit(1), "d": F.col("d")}))
    windows = df.where("d = 1 and seq % 9 = 0").select("tid", F.col("cycle").alias("w"), F.col("seq").alias("n"))
    points = df.select("tid", "seq", "cycle")
    for join in (asof.forward, asof.backward):
        assert key(join(points, windows, ["tid"], "cycle", "w", ["n"], hot=30)) == key(join(points, windows, ["tid"], "cycle", "w", ["n"]))


def test_asof_takes_time_in_proportion(spark):
    def seconds(n):
        points = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
        windows = spark.range(n // 10).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("w"))
        began = time.perf_counter()
        asof.forward(points, windows, ["k"], "t", "w", []).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 4 * seconds(20_000) + 1


def test_stack_and_queue_pairs_match_walks(spark):
    rng = random.Random(3)
    rows = [(t, s, s * 10 + rng.randrange(9), rng.choice([1, 1, -1, -1, -1])) for t in (1, 2) for s in range(80)]
    df = spark.createDataFrame(rows, "tid int, seq long, cycle long, d int").repartition(5)
    stacks, queues, parents, bad = {}, {}, {}, {1: 0, 2: 0}
    for t in (1, 2):
        stack, queue = [], []
        for _, s, c, d in [r for r in rows if r[0] == t]:
            if d == 1:
                parents[t, s] = stack[-1] if stack else None
                stack.append(s)
                queue.append(s)
                stacks[t, s] = (len(stack), None)
            elif stack:
                at = stack.pop()
                stacks[t, at] = (stacks[t, at][0], c)
                queues[t, queue.pop(0)] = c
            else:
                bad[t] += 1
    pairs = pairing.stack_pairs(df, ["tid"])
    assert {(r.tid, r.seq): (r.level, r.end_time) for r in pairs.collect()} == stacks
    assert {(r.tid, r.seq): r.parent for r in pairing.with_parent(pairs, ["tid"]).collect()} == parents
    assert {(r.tid, r.begin_seq): r.end for r in pairing.queue_pairs(df, ["tid"]).collect()} == queues
    assert {r.tid: r.unpaired_ends for r in pairing.pairing_counts(df, ["tid"]).collect()} == bad


def test_last_begin_wins(spark):
    df = spark.createDataFrame([(1, i, i * 10, d) for i, d in enumerate([1, 1, -1, -1, 1, -1])], "k int, seq long, cycle long, d int")
    assert sorted((r.begin, r.end) for r in pairing.last_begin_pairs(df, ["k"]).collect()) == [(10, 20), (40, 50)]


def test_asof_both_ways(spark):
    windows = spark.createDataFrame([(1, 10, 20, 0), (1, 20, 35, 1), (2, 5, 6, 2)], "k int, b long, e long, w int")
    points = spark.createDataFrame([(1, t) for t in (5, 10, 20, 21, 40)] + [(3, 1)], "k int, t long")
    ahead = {(r.k, r.t): r.w for r in asof.forward(points, windows, ["k"], "t", "e", ["w"]).collect()}
    behind = {(r.k, r.t): r.w for r in asof.backward(points, windows, ["k"], "t", "b", ["w"]).collect()}
    assert ahead == {(1, 5): 0, (1, 10): 0, (1, 20): 0, (1, 21): 1, (1, 40): None, (3, 1): None}
    assert behind == {(1, 5): None, (1, 10): 0, (1, 20): 1, (1, 21): 1, (1, 40): 1, (3, 1): None}


def test_distribution_and_histogram(spark):
    x = [float(i) for i in range(1, 21)]
    df = spark.createDataFrame([("a", v) for v in [*x, None]] + [("b", 300.0)], "k string, v double")
    r = dist.distribution(df, ["k"], "v", 6.0).where("k = 'a'").first()
    assert (r.n, r.p50, r.p95, r.p99, r.over, r.hitches) == (20, 10, 19, 20, 14, 8)
    many = spark.createDataFrame([(k, float(i * 7919 % 500)) for k in ("a", None) for i in range(900)], "k string, v double")
    key = lambda hot: sorted(map(str, dist.nearest_ranks(many, ["k"], "v", (0.001, 0.5, 0.95, 1.0), hot).collect()))
    assert key(50) == key(10**6) and "r0=0.0, r1=249.0, r2=" in key(50)[0]
    bins = {r.bin: (r.low, r.high, r.n) for r in dist.histogram(df, ["k"], "v", 6.0).where("k = 'a'").collect()}
    assert bins == {0: (0, 3, 2), 1: (3, 6, 3), 2: (6, 12, 6), 3: (12, None, 9)}
    assert dist.Budget.of().ms == 1000 / 60 and dist.Budget.of(ms=5).explicit
    with pytest.raises(ValueError):
        dist.Budget.of(fps=60, ms=5)
    assert [(r.k, r.s) for r in dist.busiest(spark.createDataFrame([(1, 5), (1, 4), (1, 4), (1, 5)], "k int, s int"), ["k"], ["s"]).collect()] == [(1, 4)]


def test_call_tree_self_times(spark):
    rows = [(1, 1, None, 9, 100, 1), (1, 2, 1, 8, 30, 1), (1, 3, 1, 8, 20, 2), (1, 4, 2, None, 40, 1), (2, 5, 1, 9, 7, 1), (1, 6, 1, 7, None, 1)]
    df = spark.createDataFrame(rows, "frame_id long, node_id long, parent_node_id long, spec long, inclusive long, calls int")
    assert {r.node_id: r.self for r in calltree.self_times(df).collect()} == {1: 50, 2: 0, 3: 20, 4: 40, 5: 7, 6: None}
    assert {(r.frame_id, r.path): (r.nodes, r.calls, r.inclusive) for r in calltree.rollup(df, ["frame_id"]).collect()} == {(1, "9"): (1, 1, 100), (1, "9>8"): (2, 3, 50), (1, "9>8>-1"): (1, 1, 40), (1, "9>7"): (1, 1, None), (2, "9"): (1, 1, 7)}


def test_nodes_below_a_ring_are_kept_and_counted(spark):
    rows = [(1, 1, None, 9, 10, 1), (1, 2, 1, 8, 5, 1), (1, 3, 4, 7, 3, 1), (1, 4, 3, 6, 2, 1), (1, 5, 4, 5, 1, 1), (2, 7, 99, 4, 8, 1)]
    rows += [(3, i, i - 1 or None, i, 100 - i, 1) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "frame_id long, node_id long, parent_node_id long, spec long, inclusive long, calls long")
    found = calltree.paths(df)
    got = {(r.frame_id, r.node_id): (r.level, r.path) for r in found.collect()}
    assert got[1, 2] == (2, "9>8") and got[2, 7] == (1, "4") and got[1, 3] == got[1, 4] == got[1, 5] == (None, None)
    assert got[3, 39] == (39, ">".join(map(str, range(1, 40)))) and len(got) == len(rows)
    assert [tuple(r) for r in calltree.unrooted(found, ["frame_id"]).collect()] == [(1, 3)]
    assert {(r.frame_id, r.path): r.nodes for r in calltree.rollup(df, ["frame_id"]).where("frame_id = 1").collect()} == {(1, "9"): 1, (1, "9>8"): 1, (1, None): 3}
    again = calltree.unpacked(calltree.packed(found)).collect()
    assert {(r.frame_id, r.path, r.spec, r.inclusive) for r in again} == {(r.frame_id, r.path, r.spec, r.inclusive) for r in found.where("level is not null").collect()}


def test_longest_chain(spark):
    tasks = spark.createDataFrame([(1, 5), (2, 5), (3, 2), (4, None), (5, 9), (6, 1)], "id long, duration long")
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 5), (3, 6), (6, 6), (99, 6)], "pred long, succ long")
    best = graph.longest_chains(tasks, edges)
    # 4 never ran: nothing before it counts, but it is what 5 follows
    assert {r.id: (r.total, r.parent) for r in best.collect()} == {1: (5, None), 2: (5, None), 3: (7, 1), 4: (0, None), 5: (9, 4), 6: (8, 3)}
    chain = graph.chains_to(best, spark.createDataFrame([(6,), (5,)], "id long"))
    assert sorted((r.last, r.place, r.id) for r in chain.collect()) == [(5, 1, 4), (5, 2, 5), (6, 1, 1), (6, 2, 3), (6, 3, 6)]
    assert graph.ignored_edges(tasks, edges) == 1
    ring = spark.createDataFrame([(1, 2), (2, 1)], "pred long, succ long")
    assert {r.id: (r.total, r.parent) for r in graph.longest_chains(tasks, ring).where("id < 3").collect()} == {1: (10, 2), 2: (5, None)}
    assert graph.ignored_edges(tasks, ring) == 1
    assert graph.longest_chains(tasks.where("false"), edges).count() == 0


def walked(tasks, edges):
    """The longest chains by a walk from each task to its predecessors; an edge to a task on the way is left out."""
    before = {t: sorted({p for p, s in edges if s == t and p in tasks and p != t}) for t in tasks}
    total, parent, way, ignored = {}, {}, [], set()

    def walk(t):
        if t in total:
            return
        way.append(t)
        best = (0, None)
        for p in before[t] if tasks[t] is not None else ():
            if p in way:
                ignored.add((p, t))
                continue
            walk(p)
            if best[1] is None or total[p] > best[0]:
                best = (total[p], p)
        total[t], parent[t] = best[0] + (tasks[t] or 0), best[1]
        way.pop()

    for t in sorted(tasks):
        walk(t)
    return total, parent, len(ignored)


@pytest.mark.parametrize("seed", range(3))
def test_longest_chains_match_a_walk(spark, seed):
    rng = random.Random(seed)
    tasks = {t: rng.choice([None, *range(10)]) for t in range(30)}
    edges = [tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)]
    total, parent, _ = walked(tasks, edges)
    best = graph.longest_chains(spark.createDataFrame(list(tasks.items()), "id long, duration long"), spark.createDataFrame(edges, "pred long, succ long"))
    assert {r.id: (r.total, r.parent) for r in best.collect()} == {t: (total[t], parent[t]) for t in tasks}


def test_a_cycle_is_counted_and_never_followed(spark):
    # a ring with a tail, a stretch that leads back to its head, and a chain beside them
    tasks = {t: t for t in range(1, 12)}
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 7), (7, 5), (7, 8), (9, 10), (10, 11)]
    total, parent, ignored = walked(tasks, edges)
    rows, links = spark.createDataFrame(list(tasks.items()), "id long, duration long"), spark.createDataFrame(edges, "pred long, succ long")
    assert {r.id: (r.total, r.parent) for r in graph.longest_chains(rows, links).collect()} == {t: (total[t], parent[t]) for t in tasks}
    assert graph.ignored_edges(rows, links) == ignored == 2


def test_two_thousand_tasks_in_line(spark):
    rows = spark.range(2000).select("id", F.lit(1).cast("long").alias("duration"))
    links = spark.range(1, 2000).select((F.col("id") - 1).alias("pred"), F.col("id").alias("succ"))
    last = graph.longest_chains(rows, links).where("id = 1999").first()
    assert (last.total, last.parent, last.steps) == (2000, 1998, 2000)


def one_flag(spark):
    return spark.range(1).select(scalars.flag_names(F.lit(0))).first()[0]


def test_paths_say_whose_they_are(spark):
    paths = {
        r"D:\b\Engine\Source\Runtime\Core\Private\A.cpp": ("engine", "engine-source", "Runtime", "Core", "Source/Runtime/Core/Private/A.cpp", "Runtime/Core"),
        "/x/Engine/Source/A.cpp": ("engine", "engine-source", "", "A.cpp", "Source/A.cpp", "A.cpp"),
        "Engine/Plugins/Exp/Py/Source/PyCore/B.cpp": ("engine", "engine-plugin", "Exp", "PyCore", "Plugins/Exp/Py/Source/PyCore/B.cpp", "Exp/PyCore"),
        r"D:\Studio\Game\Plugins\Perf\Source\PerfCore\Private\Waits.cpp": ("game", "project-plugin", "Perf", "PerfCore", "Plugins/Perf/Source/PerfCore/Private/Waits.cpp", "Perf/PerfCore"),
        "C:/Game/Source/Mod/C.cpp": ("game", "project", "", "Mod", "Game/Source/Mod/C.cpp", "Mod"),
        "Engine/Docs/Plugins/P/D.cpp": ("game", "project-plugin", "", "", "Plugins/P/D.cpp", "(unknown)"),
        "odd.cpp": ("unknown", "unknown", "", "", "odd.cpp", "(unknown)"),
        "C:/": (None,) * 6,
    }
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] + [(None, 99)], "path string, n int")
    got = {r.path: (r.side, r.kind, r.group, r.module, r.relative, r.label) for r in scalars.located(df, "path").collect()}
    assert got == {**paths, None: (None,) * 6}


def test_scalar_rules(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert [row(scalars.scope_kind, n) for n in ("WaitForTasks", "Deadlock", "TryLock", "Locksmith", "FMutexLocked")] == ["wait", "work", "lock", "work", "lock"]
    assert [row(scalars.role, n) for n in ("GameThread", "RenderThread 1", "RHIThread", "Worker")] == ["game", "render", "rhi", None]
    assert row(scalars.path_segments, "D:\\a/ b /./\\c.cpp") == ["a", "b", "c.cpp"] and one_flag(spark) == "none"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.flag_names(F.lit(5))) == "Important+NoSync" and one(scalars.execution(F.lit(0x101))) == "Game" and one(scalars.execution(F.lit(7))) == "thread 7"
    assert one(F.array(*scalars.queue_parts(F.lit(0x030201)))) == [2, 3, 1]
    assert tuple(one(scalars.execution_parts(F.lit(0x701)))) == ("Game", True, True, "high") and tuple(one(scalars.execution_parts(F.lit(0x8FF)))) == ("any", False, False, "background")
    assert one(scalars.clean_text(F.lit("a\0 "))) == "a" and one(scalars.clean_text(F.lit("\0"))) == "-"
    assert tuple(one(scalars.strict_cap(F.lit(2 / 30)))) == (0, 4) and one(scalars.strict_cap(F.lit(54 / 60))) is None
    assert one(scalars.at_cap(F.lit(1 / 60 + 0.0001))) and not one(scalars.at_cap(F.lit(0.0023)))
    assert math.isclose(one(scalars.speedup_ceiling(F.lit(0.5), F.lit(4))), 1.6) and one(scalars.speedup_ceiling(F.lit(0.0), F.lit(4))) == 1
    assert one(dist.milliseconds(F.lit(0), F.lit(5), F.lit(0))) is None
