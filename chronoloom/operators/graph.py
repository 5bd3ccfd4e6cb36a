"""Longest chains of work through a graph of tasks.

Three steps, each on whole tables. Cycles are found first: what stays after peeling tasks without predecessors or
successors holds every cycle, and there the edges that lead back are taken out and counted. Straight stretches, where
each task has one predecessor that has one successor, are folded by pointer doubling, so a chain of n tasks takes log n
rounds. What branches is relaxed until no total grows. Nothing is cut at a number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut_lineage


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges between tasks that lie on a cycle or between two cycles."""
    core, left = edges, edges.count()
    while left:
        inner = core.select(F.col("succ").alias("_t")).intersect(core.select(F.col("pred").alias("_t")))
        core = core.join(inner.withColumnRenamed("_t", "pred"), "pred", "left_semi").join(inner.withColumnRenamed("_t", "succ"), "succ", "left_semi")
        core = cut_lineage(core.select("pred", "succ"))
        now = core.count()
        if now == left:
            break
        left = now
    return core


def _stretches(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """id, before, head, sum, steps: where the straight stretch of each task begins and what it sums up after the head.

    head is null for the tasks of a ring from which nothing branches.
    """
    single_in = links.groupBy("succ").agg(F.count(F.lit(1)).alias("_n"), F.min("pred").alias("pred")).where("_n = 1").select("succ", "pred")
    single_out = links.groupBy("pred").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("pred")
    straight = single_in.join(single_out, "pred", "left_semi")
    made = tasks.join(straight.select(F.col("succ").alias("id"), F.col("pred").alias("before")), "id", "left")
    inner = F.col("before").isNotNull()
    # at: how far back the sum reaches; open while that is no head
    made = cut_lineage(made.select("id", "before", F.coalesce("before", "id").alias("at"), F.when(inner, F.col("own")).otherwise(0).alias("sum"), F.when(inner, 1).otherwise(0).alias("steps"), inner.alias("_open")))
    left, was = made.where("_open").count(), None
    while left and left != was:  # each round closes whatever lies up to twice as deep; what no round closes is a ring
        far = made.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("sum").alias("_sum"), F.col("steps").alias("_steps"), F.col("_open").alias("_far"))
        made = cut_lineage(made.join(far, "at").select("id", "before", F.col("_at").alias("at"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_open") & F.col("_far")).alias("_open")))
        left, was = made.where("_open").count(), left
    return made.select("id", "before", F.when(~F.col("_open"), F.col("at")).alias("head"), "sum", "steps")


def _back_of(core: DataFrame) -> DataFrame:
    """The back edges among edges that hold cycles."""
    found, core = None, _peeled(core)
    while not core.isEmpty():
        # the smallest task among those that a task leads to
        label = core.select(F.col("pred").alias("id")).union(core.select("succ")).distinct().withColumn("label", F.col("id"))
        changed = True
        while changed:
            below = core.join(label.select(F.col("id").alias("succ"), "label"), "succ").groupBy(F.col("pred").alias("id")).agg(F.min("label").alias("_below"))
            made = label.join(below, "id", "left").select("id", F.least("label", "_below").alias("label"), F.coalesce(F.col("_below") < F.col("label"), F.lit(False)).alias("_less"))
            made = cut_lineage(made)
            changed = not made.where("_less").isEmpty()
            label = made.drop("_less")
        # a task is the root of a cycle where it is its own label; the tasks after it with that label lead back to it
        back = cut_lineage(core.join(label.select(F.col("id").alias("succ"), F.col("label").alias("_to")), "succ").where("_to = pred").select("pred", "succ"))
        found = back if found is None else found.unionByName(back)
        core = _peeled(core.join(back, ["pred", "succ"], "left_anti"))
    return found if found is not None else core


def back_edges(links: DataFrame, placed: DataFrame) -> DataFrame:
    """pred, succ of the edges that lead back into a chain: without them no task comes before itself.

    links are distinct, with no edge from a task to itself; placed are their stretches. Of every cycle the edge that leaves
    its smallest task is one, as a walk from the smallest task on towards the predecessors would find it.
    """
    head = placed.select(F.col("id").alias("pred"), F.col("head").alias("_from"))
    across = links.join(head, "pred").join(placed.select(F.col("id").alias("succ"), F.col("head").alias("_to")), "succ")
    rings = across.where("_to is null").select("pred", "succ")
    between = across.where("_from <> _to or _to = succ").select(F.col("_from").alias("pred"), F.col("_to").alias("succ")).distinct()
    core = _peeled(between.where("pred <> succ"))
    # a stretch that leads to its own head is a cycle by itself
    round_ = across.where("_from = _to and _to = succ").select(F.col("_from").alias("head"))
    heads = core.select(F.col("pred").alias("head")).union(core.select("succ")).union(round_).distinct()
    inside = across.join(heads.withColumnRenamed("head", "_from"), "_from", "left_semi").join(heads.withColumnRenamed("head", "_to"), "_to", "left_semi")
    return _back_of(cut_lineage(inside.select("pred", "succ").unionByName(rings)))


def _links(tasks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with their own time, and the edges between known tasks whose later task ran."""
    known = cut_lineage(tasks.select("id", F.coalesce("duration", F.lit(0)).cast("long").alias("own"), F.col("duration").isNotNull().alias("_ran")))
    ran = known.where("_ran").select(F.col("id").alias("succ"))
    links = edges.select("pred", "succ").where("pred <> succ").distinct().join(ran, "succ", "left_semi").join(known.select(F.col("id").alias("pred")), "pred", "left_semi")
    return known.drop("_ran"), cut_lineage(links.select("pred", "succ"))


def ignored_edges(tasks: DataFrame, edges: DataFrame) -> int:
    """How many edges longest_chains leaves out because they lead back, those from a task to itself included."""
    own = edges.where("pred = succ").distinct().join(tasks.where("duration is not null").select(F.col("id").alias("succ")), "succ", "left_semi")
    known, links = _links(tasks, edges)
    return own.count() + back_edges(links, _stretches(known, links)).count()


def longest_chains(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """id, total, parent, steps: the greatest sum of durations of a chain that ends in each task.

    tasks has id and duration (null: it never ran, so nothing before it counts and it gives nothing); edges has pred and
    succ, with edges to unknown tasks or to a task itself left out, repeated ones counted once. Edges that lead back are
    ignored (back_edges). Of equally long chains the smallest parent counts; a task with no predecessor has none. steps
    counts the tasks of the chain. An empty table gives no rows.
    """
    known, links = _links(tasks, edges)
    placed = _stretches(known, links)
    back = back_edges(links, placed)
    if not back.isEmpty():
        links = cut_lineage(links.join(back, ["pred", "succ"], "left_anti"))
        placed = _stretches(known, links)
    # between stretches: from any task to the head of another stretch
    heads = placed.where("before is null").select(F.col("id").alias("succ"))
    own = known.select(F.col("id").alias("head"), "own")
    across = links.join(heads, "succ", "left_semi").join(placed.select(F.col("id").alias("pred"), F.col("head").alias("_from"), "sum", "steps"), "pred")
    across = cut_lineage(across.join(own.withColumnRenamed("head", "succ"), "succ").select("_from", "pred", F.col("succ").alias("head"), (F.col("sum") + F.col("own")).alias("_add"), (F.col("steps") + 1).alias("_more")))
    best = cut_lineage(placed.where("before is null").select(F.col("id").alias("head")).join(own, "head").select("head", F.col("own").alias("total"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("steps")))
    fresh = best
    while True:
        reached = across.join(fresh.select(F.col("head").alias("_from"), "total", "steps"), "_from").select("head", (F.col("total") + F.col("_add")).alias("total"), F.col("pred").alias("parent"), (F.col("steps") + F.col("_more")).alias("steps"))
        better = F.struct("total", (-F.col("parent")).alias("order"), "parent", "steps")
        reached = reached.groupBy("head").agg(F.max(better).alias("_b")).select("head", "_b.total", "_b.parent", "_b.steps")
        old = best.select("head", F.struct("total", (-F.col("parent")).alias("order"), "parent", "steps").alias("_old"))
        joined = reached.join(old, "head").where((F.col("total") > F.col("_old.total")) | ((F.col("total") == F.col("_old.total")) & (F.col("_old.parent").isNull() | (F.col("parent") < F.col("_old.parent")) | ((F.col("parent") == F.col("_old.parent")) & (F.col("steps") != F.col("_old.steps"))))))
        fresh = cut_lineage(joined.select("head", "total", "parent", "steps"))
        if fresh.isEmpty():
            break
        best = cut_lineage(best.join(fresh.select("head"), "head", "left_anti").unionByName(fresh))
    whole = placed.join(best.select("head", F.col("total").alias("_t"), F.col("parent").alias("_p"), F.col("steps").alias("_s")), "head")
    return whole.select("id", (F.col("_t") + F.col("sum")).alias("total"), F.coalesce("before", "_p").alias("parent"), (F.col("_s") + F.col("steps")).alias("steps"))


def chains_to(best: DataFrame, last: DataFrame) -> DataFrame:
    """last, id, place: the tasks of the chain that ends in each of last (a column id), place 1 the oldest.

    The tasks n, 2n, 4n ... parents back are found in turn, so a chain of n tasks takes log n rounds.
    """
    jump = cut_lineage(best.where("parent is not null").select("id", F.col("parent").alias("up")))
    found = cut_lineage(last.select(F.col("id").alias("last"), "id"))
    while True:
        more = cut_lineage(found.join(jump, "id").select("last", F.col("up").alias("id")))
        if more.isEmpty():
            return found.join(best.select("id", F.col("steps").alias("place")), "id").select("last", "id", "place")
        found = found.unionByName(more)
        jump = cut_lineage(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_far")), "up").select("id", F.col("_far").alias("up")))
