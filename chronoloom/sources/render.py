"""Small results as text for people: tables, graphs, baselines and the per-frame CSV layout."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE = "chronoloom.baseline/1"
ADVICE = "chronoloom.advice/1"
COMPARISON = "chronoloom.comparison/1"


def rows_as(df: DataFrame, form: str = "table", limit: int = 40) -> str:
    """A frame as an aligned table, csv or markdown; limit 0 shows all rows, null is '-'."""
    rows = (df.limit(limit) if limit > 0 else df).collect()  # a report for people; 0 is for those whose size is known
    cells = [["-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([df.columns, *cells])
        return out.getvalue()
    if form == "markdown":
        bars = [[c.replace("|", "\\|") for c in row] for row in [df.columns, ["---"] * len(df.columns), *cells]]
        return "".join(f"| {' | '.join(row)} |\n" for row in bars)
    if form != "table":
        raise ValueError(f"no form {form!r}")
    widths = [max(len(r[i]) for r in [df.columns, *cells]) for i in range(len(df.columns))]
    numeric = [t in ("int", "bigint", "double", "float", "smallint") for _, t in df.dtypes]
    line = lambda row: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(row, widths, numeric, strict=True)).rstrip() + "\n"
    return "".join(map(line, [df.columns, *cells]))


@dataclass(frozen=True)
class GraphForm:
    """How a form of graph is written: its frame, a node, an edge, and what stands for a quotation mark in a label."""

    frame: str
    node: str
    edge: str
    quote: str


GRAPH_FORMS = {
    "dot": GraphForm("digraph {{\n  rankdir=LR\n{}}}\n", '  n{at} [label="{name}"]\n', "  n{a} -> n{b}\n", '\\"'),
    "mermaid": GraphForm("flowchart LR\n{}", '  n{at}["{name}"]\n', "  n{a} --> n{b}\n", "&quot;"),
}


def graph_as(tasks: Iterable[tuple[int, str]], edges: Iterable[tuple[int, int]], form: str = "dot") -> str:
    """Tasks and edges as DOT, Mermaid or JSON. Nodes are numbered in order of the tasks' ids; edges to other tasks are left out."""
    names = dict(sorted(tasks))
    place = {task: at for at, task in enumerate(names)}
    links = sorted({(a, b) for a, b in edges if a in place and b in place})
    if form == "json":
        return json.dumps({"tasks": [{"id": i, "name": n} for i, n in names.items()], "edges": [list(e) for e in links]})
    if form not in GRAPH_FORMS:
        raise ValueError(f"no form {form!r}")
    how = GRAPH_FORMS[form]
    lines = [how.node.format(at=place[i], name=n.replace("\\", "\\\\").replace('"', how.quote)) for i, n in names.items()]
    return how.frame.format("".join(lines + [how.edge.format(a=place[a], b=place[b]) for a, b in links]))


def advice_json(findings: DataFrame, capture_id: int, meta: dict[str, str | int | float | None]) -> str:
    """The ranked findings of one capture with a block that says what they were made from."""
    rows = findings.where(F.col("capture_id") == capture_id).orderBy("place").drop("capture_id").collect()  # one of each rule at most
    return json.dumps({"schema": ADVICE, "meta": {**meta, "capture_id": capture_id}, "findings": [r.asDict() for r in rows]}, indent=1)


def comparison_as(compared: DataFrame, app: str, form: str = "json") -> str:
    """One app's comparison as JSON with its gate, or as a markdown table: the worse metrics first."""
    order = F.array_position(F.array(*map(F.lit, ("worse", "better", "same", "unknown"))), F.col("verdict"))
    rows = compared.where(F.col("app") == app).orderBy(order, "key").drop("app")  # one of each metric
    if form == "markdown":
        return rows_as(rows, "markdown", 0)
    held = [r.asDict() for r in rows.collect()]
    return json.dumps({"schema": COMPARISON, "app": app, "passed": all(r["verdict"] != "worse" for r in held), "metrics": held}, indent=1)


def write_baseline(metrics: DataFrame, path: str) -> None:
    """Metrics key, value as a JSON file that people can compare."""
    values = {r.key: r.value for r in metrics.select("key", "value").collect()}
    with open(path, "w") as file:
        json.dump({"schema": BASELINE, "metrics": dict(sorted(values.items()))}, file, indent=1)


def read_baseline(path: str) -> dict[str, float | None]:
    with open(path) as file:
        held = json.load(file)
    if held.get("schema") != BASELINE:
        raise ValueError(f"{path} is no baseline")
    return held["metrics"]


#: Decimal places of numbers below a bound; whole numbers have none.
PLACES = ((0.1, 6), (float("inf"), 4))


def number(value: Column) -> Column:
    """A number as the CSV layout has it, an expression."""
    text = F.format_string("%.0f", value)
    small = F.lit(None).cast("string")
    for bound, places in reversed(PLACES):
        small = F.when(F.abs(value) < bound, F.format_string(f"%.{places}f", value)).otherwise(small)
    return F.when(value == F.rint(value), text).otherwise(small)


def frame_lines(values: DataFrame, events: DataFrame, frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """frame, line: the cells of each frame joined, its events first and 0 where a series has no value."""
    clean = lambda c: F.translate(c, ",;", "..")
    cells = values.groupBy("frame").agg(*[F.first(F.when(F.col("series") == n, number(F.col("value"))), ignorenulls=True).alias(f"_{i}") for i, n in enumerate(names)]) if names else values.select("frame").distinct()
    at = F.col("seconds") if "seconds" in events.columns else F.lit(None).cast("double")
    text = F.concat(clean("name"), F.when(at.isNotNull(), F.concat(F.lit("##"), F.format_string("%.6f", at))).otherwise(""))
    listed = F.sort_array(F.collect_list(F.struct(at.alias("at"), text.alias("text"))))
    said = events.groupBy("frame").agg(F.array_join(F.transform(listed, lambda e: e["text"]), ";").alias("_said"))
    joined = frames.select("frame").join(cells, "frame", "left").join(said, "frame", "left")
    return joined.select("frame", F.concat_ws(",", F.coalesce("_said", F.lit("")), *[F.coalesce(f"_{i}", F.lit("0")) for i in range(len(names))]).alias("line"))


def write_frame_csv(values: DataFrame, events: DataFrame, frames: DataFrame | Sequence[int], path: str, metadata: dict[str, str]) -> None:
    """One line per frame: events, then the series in order of name; metadata last.

    values has frame, series, value; events has frame, name and, where known, seconds, which then stand with the name and
    order the events of a frame; frames gives the frames to write. Lines are made in tasks and
    come to the driver a partition at a time.
    """
    if not isinstance(frames, DataFrame):
        frames = values.sparkSession.createDataFrame([(f,) for f in frames], "frame long")
    names = sorted(r.series for r in values.select("series").distinct().collect())  # as many as there are stats
    tidy = str.maketrans(",;", "..")
    with open(path, "w") as file:
        file.write(",".join(["EVENTS", *(n.translate(tidy) for n in names)]) + "\n")
        for row in frame_lines(values, events, frames, names).orderBy("frame").toLocalIterator():
            file.write(row.line + "\n")
        file.write(",".join(f"[{k}],{v.translate(tidy)}" for k, v in metadata.items()) + "\n")
