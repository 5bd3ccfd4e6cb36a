"""Sources too large for one task, judged as spikes.judge judges a whole source.

The readings of a source are cut by their position into pieces. What judge takes from the whole source (constancy, run
lengths, scatter, quantum, recurrence) is aggregated over the pieces first and then given to each of them, with the
readings beside it; runs are joined across pieces. Excursions that may reach over a border are judged with both sides.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import spikes as one
from chronoloom.session import cut_lineage

#: Readings beside a piece that come along. An excursion looks at no more than 11 readings after its first and 9 before.
HALO = 16
_LISTS = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
Facts = dict[str, dict[str, Any]]


def _cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted readings of a partition to rows (source, no, ids, values, flags) of at most block readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, no = pa.Table.from_batches(held), TaskContext.get().partitionId() << 24
        source = table.column("_source").combine_chunks().dictionary_encode()
        source = source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source
        places = source.indices.to_numpy()
        ids, values, flags = table.column("_id").to_numpy(), table.column("_value").to_numpy(), table.column("_impossible").to_numpy()
        borders = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1, [len(ids)]])
        for a, b in zip(borders, borders[1:], strict=False):
            for i in range(a, b, block):
                j, no = min(b, i + block), no + 1
                lists = [pa.array([x[i:j]], kind) for x, kind in zip((ids, values, flags), _LISTS, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([source.dictionary[int(places[a])].as_py()]), pa.array([no - 1]), *lists], names=["_source", "_no", "_ids", "_values", "_flags"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("_source")[i].as_py(), batch.column("_no")[i].as_py(), *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_ids", "_values", "_flags"))


def _told(pieces: DataFrame, tell: Callable[..., dict]) -> dict[str, list[tuple[int, dict]]]:
    """What tell says of each piece, by source and in order: a small row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, no, ids, values, flags in _read(batches):
            said = tell(source, no, ids, values, flags)
            yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([no]), pa.array([pickle.dumps(said)], pa.binary())], names=["source", "no", "said"])

    told: dict[str, list[tuple[int, dict]]] = {}
    for row in pieces.mapInArrow(run, "source string, no long, said binary").collect():
        told.setdefault(row.source, []).append((row.no, pickle.loads(row.said)))
    return {source: sorted(said, key=lambda s: s[0]) for source, said in told.items()}


def _values(pieces: DataFrame, give: Callable[..., dict[int, np.ndarray]]) -> DataFrame:
    """source, tag, v: the numbers that give has of each piece by tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, no, ids, values, flags in _read(batches):
            for tag, v in give(source, no, ids, values, flags).items():
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(v)), pa.array(np.full(len(v), tag, np.int32)), pa.array(np.asarray(v, float))], names=["source", "tag", "v"])

    return pieces.mapInArrow(run, "source string, tag int, v double")


def _medians(values: DataFrame) -> dict[tuple[str, int], float]:
    """The exact median of each source and tag: it lies between two approximate quantiles, whose few values are counted."""
    keys = ["source", "tag"]
    near = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("v", [0.499, 0.501], 10_000).alias("_p"))
    inside = values.join(near, keys).where(F.col("v") <= F.col("_p")[1]).withColumn("v", F.when(F.col("v") >= F.col("_p")[0], F.col("v")))
    counted = inside.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    at = lambda p: F.max(F.when((F.col("_from") <= F.expr(p)) & (F.expr(p) < F.col("_upto")), F.col("v")))
    found = {}
    for row in placed.groupBy(*keys).agg(at("(_n - 1) div 2").alias("a"), at("_n div 2").alias("b")).collect():
        if row.a is None or row.b is None:
            raise RuntimeError(f"no median of {row.source}")
        found[row.source, row.tag] = (row.a + row.b) / 2
    return found


def _quanta(values: DataFrame, parts: int) -> dict[str, float]:
    """The least step between different values of each source; 0 where all are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}
        for batch in batches:
            names, v = np.array(batch.column("source").to_pylist(), object), batch.column("v").to_numpy()
            for name in dict.fromkeys(names):
                own = v[names == name]
                gaps = np.diff(own if name not in ends else np.concatenate([[ends[name][1]], own]))
                first, _, gap = ends.get(name, (own[0], own[0], math.inf))
                ends[name] = (first, own[-1], min([gap, *gaps[gaps > 0]]))
        if ends:
            columns = list(zip(*((name, part, *map(float, e)) for name, e in ends.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["source", "part", "first", "last", "gap"])

    ranged = values.select("source", "v").distinct().repartitionByRange(parts, "source", "v").sortWithinPartitions("source", "v")
    least: dict[str, float] = {}
    last: dict[str, float] = {}
    for row in sorted(ranged.mapInArrow(run, "source string, part long, first double, last double, gap double").collect(), key=lambda r: r.part):
        gap = row.first - last[row.source] if row.source in last else 0.0
        least[row.source] = min(least.get(row.source, math.inf), row.gap, gap if gap > 0 else math.inf)
        last[row.source] = row.last
    return {source: gap if gap < math.inf else 0.0 for source, gap in least.items()}


def _kept(values: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(~np.isnan(values) & ~flags)
    return values[at], at


def _first_look(source: str, no: int, ids: np.ndarray, values: np.ndarray, flags: np.ndarray) -> dict:
    x, at = _kept(values, flags)
    said = {"rows": len(values), "n": len(x)}
    if len(x):
        lengths = one._runs(x)[1]
        inner = lengths[1:-1]
        usual = inner[inner < one.LEAST_RUN]
        said |= {"runs": (int(lengths[0]), int(lengths[-1]), len(lengths)), "pairs": int(usual.sum()), "equal": int((usual - 1).sum()), "long": bool((inner >= one.LEAST_RUN).any())}
        said |= {"head": (x[:HALO], at[:HALO]), "tail": (x[-HALO:], at[-HALO:]), "low": float(x.min()), "high": float(x.max())}
    return said


def _joined_runs(said: list[tuple[int, dict]]) -> dict[str, Any]:
    """Facts of a source from those of its pieces: position, constancy, the least stuck run, and the whole lengths of the runs at borders."""
    facts: dict[str, Any] = {"n": sum(s["n"] for _, s in said), "pieces": {}}
    base, totals, value = 0, [], None
    for no, s in said:
        if s["n"]:
            first, last, count = s["runs"]
            if totals and s["head"][0][0] == value:
                totals[-1] += first
            else:
                totals.append(first)
            mine = [len(totals) - 1]
            if count > 1:
                totals.append(last)
            facts["pieces"][no] = {"base": base, "n": s["n"], "runs": (*mine, len(totals) - 1), "head": (s["head"][0], s["head"][1] + base), "tail": (s["tail"][0], s["tail"][1] + base)}
            value = s["tail"][0][-1]
        base += s["rows"]
    for piece in facts["pieces"].values():
        piece["runs"] = tuple(totals[i] for i in piece["runs"])
    there = [s for _, s in said if s["n"]]
    facts["constant"] = not there or min(s["low"] for s in there) == max(s["high"] for s in there)
    short = [t for t in totals if t < one.LEAST_RUN]
    long = any(s["long"] for s in there) or len(short) < len(totals)
    pairs, equal = sum(s["pairs"] for s in there) + sum(short), sum(s["equal"] for s in there) + sum(t - 1 for t in short)
    facts["limit"] = one.run_limit(pairs, equal, facts["n"]) if long and not facts["constant"] else math.inf
    return facts


def _fixed(x: np.ndarray, piece: dict, limit: float) -> np.ndarray:
    own = one._runs(x)[1]
    whole = own.copy()
    whole[0], whole[-1] = piece["runs"]
    return np.repeat(whole >= limit, own)


def _beside(facts: dict[str, Any]) -> None:
    """Gives each piece the HALO readings before and after it: their values, positions and whether they are stuck."""
    numbers = list(facts["pieces"])
    for k, no in enumerate(numbers):
        for side, others, end in (("before", numbers[:k][::-1], "tail"), ("after", numbers[k + 1 :], "head")):
            parts, n = [], 0
            for other in others:
                if n >= HALO:
                    break
                parts.append((*facts["pieces"][other][end], facts["pieces"][other]["stuck"][end]))
                n += len(parts[-1][0])
            if side == "before":
                parts = parts[::-1]
            kinds = (float, np.int64, bool)
            made = [np.concatenate([np.empty(0, t), *(p[i] for p in parts)]).astype(t) for i, t in enumerate(kinds)]
            facts["pieces"][no][side] = [m[-HALO:] if side == "before" else m[:HALO] for m in made]


class _View:
    """A piece with what lies beside it: x, at and fixed, of which lo to hi are its own."""

    def __init__(self, facts: dict[str, Any], no: int, values: np.ndarray, flags: np.ndarray):
        piece = facts["pieces"][no]
        x, self.places = _kept(values, flags)
        own = (x, self.places + piece["base"], _fixed(x, piece, facts["limit"]))
        self.x, self.at, self.fixed = (np.concatenate([b, o, a]) for b, o, a in zip(piece["before"], own, piece["after"], strict=True))
        self.lo, self.hi = len(piece["before"][0]), len(piece["before"][0]) + len(x)
        self.first, self.last = len(piece["before"][0]) == 0, len(piece["after"][0]) == 0
        self.facts = facts

    def own(self, x: np.ndarray) -> np.ndarray:
        return x[self.lo : self.hi]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Details of the finest resolution that end in this piece, repeats inside stuck runs left out."""
        a = max(self.lo, 1)
        free = ~(self.fixed[a : self.hi] & self.fixed[a - 1 : self.hi - 1])
        return (x[a : self.hi] - x[a - 1 : self.hi - 1])[free]

    def rest(self) -> np.ndarray:
        return self.own(one.off_base(self.x))

    def flat(self) -> np.ndarray:
        best = self.facts.get("best")
        if best is None:
            return self.x
        period, phase, middle = best
        y = self.x.copy()
        y[(self.at % period == phase) & ~self.fixed] -= middle
        return y

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        y = self.flat()
        edges = one.edges(y, self.facts["scale"])
        edges[0] = self.first
        return self.own(y), self.own(edges)


def _borders(edges: np.ndarray) -> tuple[int, int]:
    """Up to where excursions may depend on the piece before, and from where on the piece after. Up to >= from: all of it does."""
    n, opening = len(edges), np.flatnonzero(edges).tolist()
    upto, since = HALO, n - HALO
    for o in opening:
        if o >= upto:
            break
        upto = o + HALO
    for o in reversed(opening):
        if o < since:
            break
        since = o - HALO
    return upto, since


def _scales(pieces: DataFrame, facts: Facts, sources: list[str], of: Callable[[_View], np.ndarray]) -> dict[str, float]:
    """spikes._scale of each source."""
    view = lambda s, no, values, flags: _View(facts[s], no, values, flags) if s in sources and no in facts[s]["pieces"] else None

    def steps(s, no, ids, values, flags):
        v = view(s, no, values, flags)
        return {} if v is None else {0: v.steps(of(v))}

    middle = _medians(_values(pieces, steps))

    def away(s, no, ids, values, flags):
        return {t: np.abs(d - middle[s, 0]) for t, d in steps(s, no, ids, values, flags).items() if len(d)}

    rough = {s: one._NORMAL * m for (s, _), m in _medians(_values(pieces, away)).items()}

    def squares(s, no, ids, values, flags):
        d = away(s, no, ids, values, flags).get(0, np.empty(0))
        d = d[d <= one.ORDINARY * rough.get(s, 0.0)]
        return {"n": len(d), "sum": float(np.dot(d, d))}

    told = _told(pieces, squares)
    return {s: (math.fsum(p["sum"] for _, p in told[s]) / sum(p["n"] for _, p in told[s]) / 2) ** 0.5 if rough.get(s) else 0.0 for s in sources}


def _recurrences(pieces: DataFrame, facts: Facts, sources: list[str], scale: dict[str, float]) -> None:
    """Sets best of each source: the period, phase and size that spikes.without_recurrence takes out."""
    there = lambda s, no: s in sources and facts[s]["n"] >= 9 and no in facts[s]["pieces"]

    def standing(s, no, values, flags):
        v = _View(facts[s], no, values, flags)
        rest = v.rest()
        return rest, np.abs(rest) > one.STEP * scale[s], v.own(v.at), ~v.own(v.fixed)

    def counts(s, no, ids, values, flags):
        if not there(s, no):
            return {}
        _, out, at, free = standing(s, no, values, flags)
        by = lambda which, p: np.bincount(at[which] % p, minlength=p)
        return {"out": int(out.sum()), "standing": int((out & free).sum()), "counted": [by(out & free, p) for p in one.PERIODS], "sizes": [by(free, p) for p in one.PERIODS]}

    known: dict[str, dict] = {}
    for s, said in _told(pieces, counts).items():
        parts = [p for _, p in said if p]
        if not parts or sum(p["out"] for p in parts) < 3:
            continue
        known[s] = {"standing": sum(p["standing"] for p in parts), "phases": []}
        for k, period in enumerate(one.PERIODS):
            counted, sizes = sum(p["counted"][k] for p in parts), sum(p["sizes"][k] for p in parts)
            known[s]["phases"] += [(period, int(f), int(sizes[f])) for f in np.flatnonzero(one.recurring(counted, sizes, facts[s]["n"]))]
    if not any(k["phases"] for k in known.values()):
        return

    def phases(s, no, ids, values, flags):
        if s not in known or not there(s, no):
            return {}
        rest, _, at, free = standing(s, no, values, flags)
        return {i: rest[(at % p == f) & free] for i, (p, f, _) in enumerate(known[s]["phases"])}

    middle = _medians(_values(pieces, phases))

    def hits(s, no, ids, values, flags):
        if s not in known or not there(s, no):
            return {}
        rest, out, at, free = standing(s, no, values, flags)
        return {i: int((out & (at % p == f) & free & (np.sign(rest) == np.sign(middle[s, i]))).sum()) for i, (p, f, _) in enumerate(known[s]["phases"])}

    for s, said in _told(pieces, hits).items():
        best = None
        for i, (period, phase, size) in enumerate(known[s]["phases"]) if s in known else ():
            hit = sum(p.get(i, 0) for _, p in said)
            if hit >= 3 and hit >= 0.65 * size and abs(middle[s, i]) > one.STEP * scale[s]:
                covered = hit / max(1, known[s]["standing"])
                if best is None or covered > best[0] + 1e-9:
                    best = (covered, (period, phase, middle[s, i]))
        if best is not None and best[0] >= 0.4:
            facts[s]["best"] = best[1]


def _learn(pieces: DataFrame, parts: int) -> Facts:
    """Every figure of the whole sources that the pieces need."""
    facts = {s: _joined_runs(said) for s, said in _told(pieces, _first_look).items()}

    def ends(s, no, ids, values, flags):
        if no not in facts[s]["pieces"]:
            return {}
        fixed = _fixed(_kept(values, flags)[0], facts[s]["pieces"][no], facts[s]["limit"])
        return {"head": fixed[:HALO], "tail": fixed[-HALO:], "free": int((~fixed).sum())}

    for s, said in _told(pieces, ends).items():
        for no, stuck in said:
            if stuck:
                facts[s]["pieces"][no]["stuck"] = stuck
        _beside(facts[s])
    sources = [s for s, f in facts.items() if not f["constant"] and f["n"] >= one.LEAST_READINGS]
    for s in sources:
        facts[s]["spikes"] = True
    if not sources:
        return facts
    view = lambda s, no, values, flags: _View(facts[s], no, values, flags) if s in sources and no in facts[s]["pieces"] else None

    def plain(s, no, ids, values, flags):
        v = view(s, no, values, flags)
        return {} if v is None else {0: v.own(v.x)}

    def rests(s, no, ids, values, flags):
        v = view(s, no, values, flags)
        return {} if v is None or facts[s]["n"] < 9 else {0: np.abs(v.rest()[~v.own(v.fixed)])}

    quantum = _quanta(_values(pieces, plain), parts)
    rough = _scales(pieces, facts, sources, lambda v: v.x)
    usual = _medians(_values(pieces, rests))
    least = {s: max(quantum[s] / 4, 1e-9) for s in sources}
    outer = {s: max(rough[s], least[s]) for s in sources}
    outer = {s: max(min(outer[s], one._NORMAL * usual[s, 0]) if (s, 0) in usual else outer[s], least[s]) for s in sources}
    _recurrences(pieces, facts, sources, outer)
    again = [s for s in sources if "best" in facts[s]]
    flat = rough | (_scales(pieces, facts, again, lambda v: v.flat()) if again else {})

    def sizes(s, no, ids, values, flags):
        v = view(s, no, values, flags)
        return {} if v is None else {0: np.abs(v.own(v.flat()))}

    level = _medians(_values(pieces, sizes))
    for s in sources:
        facts[s]["scale"] = max(flat[s], quantum[s] / 3, 1e-6 * level[s, 0], 1e-300)

    def through(s, no, ids, values, flags):
        v = view(s, no, values, flags)
        if v is None:
            return {}
        upto, since = _borders(v.edges()[1])
        return {"through": upto >= since}

    for s, said in _told(pieces, through).items():
        border = 0
        for no, p in said:
            if p:  # all pieces whose excursions may depend on each other share a border
                facts[s]["pieces"][no]["borders"] = (border, border := border + (not p["through"]))
    return facts


_FOUND = "source string, border long, no long, ids array<long>, y array<double>, edges array<boolean>, fixed array<boolean>, scale double, kind string"


def _judge_pieces(facts: Facts):
    """Rows of what a piece alone shows (border null, kind set), and of what is still to be seen across a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), _LISTS[0], _LISTS[1], _LISTS[2], _LISTS[2], pa.float64(), pa.string())
        names = ["source", "border", "no", "ids", "y", "edges", "fixed", "scale", "kind"]

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        found = lambda s, no, ids, kind: row(s, None, no, ids, None, None, None, None, kind)
        for s, no, ids, values, flags in _read(batches):
            if flags.any():
                yield found(s, no, ids[flags & ~np.isnan(values)], "impossible")
            if facts[s]["constant"] or no not in facts[s]["pieces"]:
                continue
            v = _View(facts[s], no, values, flags)
            fixed, kept = v.own(v.fixed), ids[v.places]
            if fixed.any():
                yield found(s, no, kept[fixed], "stuck")
            if "spikes" not in facts[s]:
                continue
            y, edges = v.edges()
            upto, since = _borders(edges)
            left, right = facts[s]["pieces"][no]["borders"]
            whole = lambda a, b, border, no: row(s, border, no, kept[a:b], y[a:b], edges[a:b], fixed[a:b], facts[s]["scale"], None)  # noqa: E731,B023
            if left == right:
                yield whole(0, len(y), left, 2 * no)
                continue
            yield whole(0, upto, left, 2 * no)
            yield whole(since, len(y), right, 2 * no + 1)
            a, b = upto - HALO, since + HALO
            inner = np.zeros(len(y), bool)
            inner[upto:since] = edges[upto:since]
            taken = one.excursions(y[a:b], edges[a:b], fixed[a:b], facts[s]["scale"], inner[a:b])
            if taken.any():
                yield found(s, no, kept[a:b][taken], "spike")

    return run


def _judge_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source, border and no: each border's rows joined and searched."""

    def answer(key, rows) -> pa.RecordBatch:
        ids, y, edges, fixed = (np.concatenate([r[i] for r in rows]) for i in range(4))
        hit = ids[one.excursions(y, edges, fixed, rows[0][4])]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hit), pa.string()), pa.array(hit, pa.int64()), pa.array(["spike"] * len(hit), pa.string())], names=["source", "id", "kind"])

    key, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            now = (batch.column("source")[i].as_py(), batch.column("border")[i].as_py())
            if key is not None and now != key:
                yield answer(key, held)
                held = []
            key = now
            held.append([*(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "y", "edges", "fixed")), batch.column("scale")[i].as_py()])
    if held:
        yield answer(key, held)


def judge_hot(rows: DataFrame, total: int, block: int) -> DataFrame:
    """source, id, kind of the implausible readings among rows (_source, _order, _id, _value, _impossible), total of them."""
    parts = max(1, -(-total // block))
    key = ["_source", "_order", "_id"]
    single = rows.groupBy(*key).agg(F.min(F.struct("_value", "_impossible")).alias("_r")).select(*key, "_r.*")
    ranged = single.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    pieces = cut_lineage(ranged.mapInArrow(_cut(block), "_source string, _no long, _ids array<long>, _values array<double>, _flags array<boolean>"))
    facts = _learn(pieces, parts)
    made = cut_lineage(pieces.mapInArrow(_judge_pieces(facts), _FOUND))
    alone = made.where("border is null").select("source", F.explode("ids").alias("id"), "kind")
    across = made.where("border is not null").repartition("source", "border").sortWithinPartitions("source", "border", "no")
    return alone.unionByName(across.mapInArrow(_judge_borders, "source string, id long, kind string"))
