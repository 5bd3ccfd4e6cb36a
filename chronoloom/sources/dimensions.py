"""The tables of a capture from the events that its source reads: session, threads, timers, specs, marks and channels.

All functions take the table `events` of the capture source and keep the captures of several files apart by path. A later
definition of an id replaces an earlier one. Text that is not there is empty, a number that is not there is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalars import queue_parts, role, scope_kind
from chronoloom.operators.hot import Cut
from chronoloom.sources.capture import WARNINGS

# fixed values: the names of events and of their fields
TASKS = "TaskTrace"
GPU = "GpuProfiler"
GPU_EVENTS = {"EventBeginWork": "BeginWork", "EventEndWork": "EndWork", "EventBeginBreadcrumb": "BeginCrumb", "EventEndBreadcrumb": "EndCrumb", "EventWait": "Wait", "EventFrameBoundary": "Boundary", "EventStats": "Stats", "SignalFence": "Signal", "WaitFence": "WaitFence"}


def _of(events: DataFrame, logger: str, *names: str) -> DataFrame:
    return events.where((F.col("logger") == logger) & F.col("name").isin(*names))


def _int(name: str) -> Column:
    return F.try_element_at("whole", F.lit(name)).cast("long")


def _str(name: str) -> Column:
    return F.coalesce(F.try_element_at("text", F.lit(name)), F.lit(""))


def _last(rows: DataFrame, id_: Column, **columns: Column) -> DataFrame:
    """path, id and columns of the last definition of each id; definitions without an id are left out."""
    made = rows.select("path", id_.alias("id"), F.struct("tid", "seq").alias("_at"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_row")).where("id is not null")
    return made.groupBy("path", "id").agg(F.max_by("_row", "_at").alias("_row")).select("path", "id", "_row.*")


def session(events: DataFrame) -> DataFrame:
    """One row a file: the clock, what was recorded, and the version of the GPU channel."""
    at = F.struct("tid", "seq")
    trace, about = (F.col("name") == "NewTrace") & (F.col("logger") == "$Trace"), (F.col("logger") == "Diagnostics") & (F.col("name") == "Session2")
    timing, gpu = (F.col("logger") == "$Trace") & (F.col("name") == "ThreadTiming"), (F.col("logger") == GPU) & (F.col("name") == "Init")
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when & value.isNotNull(), at))
    zero = lambda value, when: F.coalesce(last(value, when), F.lit(0))
    return events.groupBy("path").agg(
        zero(_int("StartCycle"), trace).alias("start_cycle"), zero(_int("CycleFrequency"), trace).alias("cycle_frequency"), zero(_int("Endian"), trace).alias("endian"), zero(_int("PointerSize"), trace).alias("pointer_size"),
        last(F.try_element_at("real", F.lit("StartDateTime")), trace).alias("start_date_time"), last(_int("BaseTimestamp"), timing).alias("base_timestamp"), last(_int("Version"), gpu).alias("gpu_channel_version"),
        *[last(_str(f), about).alias(n) for f, n in (("Platform", "platform"), ("AppName", "app"), ("ProjectName", "project"), ("Branch", "branch"), ("BuildVersion", "build_version"), ("ConfigurationType", "configuration"), ("TargetType", "target"))],
        last(_int("Changelist"), about).alias("changelist"),
    )


def threads(events: DataFrame) -> DataFrame:
    """path, id, name, system_id, group, role, events, sync_events, end_cycle: declared threads, and those with events alone.

    The group is the one last begun before the thread was declared, none once it ended.
    """
    rows = _of(events, "$Trace", "ThreadInfo", "ThreadGroupBegin", "ThreadGroupEnd")
    marks = F.when(F.col("name") == "ThreadGroupBegin", _str("Name")).when(F.col("name") == "ThreadGroupEnd", F.lit(""))
    grouped = Cut(rows, ["path", "tid"], ["seq"], "seq").running("group", "last", marks).done().where("name = 'ThreadInfo'")
    named = _last(grouped, _int("ThreadId"), name=_str("Name"), system_id=_int("SystemId"), group=F.coalesce("group", F.lit("")))
    ends = _of(events, "CpuProfiler", "EndThread").groupBy("path", F.col("tid").cast("long").alias("id")).agg(F.max_by(_int("Cycle"), "seq").alias("end_cycle"))
    counts = events.groupBy("path", F.col("tid").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("events"), F.count("serial").alias("sync_events"))
    joined = counts.where("id > 1").join(named, ["path", "id"], "full").join(ends, ["path", "id"], "left")
    return joined.select("path", "id", F.coalesce("name", F.lit("")).alias("name"), "system_id", F.coalesce("group", F.lit("")).alias("group"), role(F.coalesce("name", F.lit(""))).alias("role"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("sync_events", F.lit(0)).alias("sync_events"), "end_cycle")


def timers(events: DataFrame) -> DataFrame:
    """path, id, name, file, line, kind: the timers, with what their name makes of a scope."""
    made = _last(_of(events, "CpuProfiler", "EventSpec"), _int("Id"), name=_str("Name"), file=_str("File"), line=F.coalesce(_int("Line"), F.lit(0)))
    return made.withColumn("kind", scope_kind(F.col("name")))


def named(rows: DataFrame, timers_: DataFrame, spec: str = "spec") -> DataFrame:
    """rows (path, spec, ...) with name: that of the timer, 'spec N' where it is not declared."""
    known = timers_.select("path", F.col("id").alias(spec), F.nullif("name", F.lit("")).alias("name"))
    return rows.join(known, ["path", spec], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("spec "), F.col(spec))))


def gpu_specs(events: DataFrame) -> DataFrame:
    """path, id, name of the passes of the older GPU channel; names are UTF-16."""
    text = F.regexp_replace(F.decode(F.try_element_at("bytes", F.lit("Name")), "UTF-16LE"), "\\x00+$", "")
    return _last(_of(events, GPU, "EventSpec"), _int("EventType"), name=F.coalesce(text, _str("Name")))


def gpu_queues(events: DataFrame) -> DataFrame:
    """path, id, name, gpu, index, type of the declared queues."""
    made = _last(_of(events, GPU, "QueueSpec"), _int("QueueId"), name=_str("TypeString"))
    gpu, index, kind = queue_parts(F.col("id"))
    return made.withColumns({"gpu": gpu, "index": index, "type": kind})


def crumb_specs(events: DataFrame) -> DataFrame:
    """path, id, static_name, name_format, fields (the bytes of their names) and shown, the name that a report prints."""
    made = _last(_of(events, GPU, "EventBreadcrumbSpec"), _int("SpecId"), static_name=_str("StaticName"), name_format=_str("NameFormat"), fields=F.coalesce(F.length(F.try_element_at("bytes", F.lit("FieldNames"))), F.lit(0)))
    return made.withColumn("shown", F.coalesce(F.nullif("name_format", F.lit("")), F.nullif("static_name", F.lit("")), F.concat(F.lit("spec "), "id")))


def bookmarks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, cycle, point, name, file, line of the bookmarks whose point is declared; and path, unknown: how many are not."""
    specs = _last(_of(events, "Misc", "BookmarkSpec"), _int("BookmarkPoint"), name=_str("FormatString"), file=_str("FileName"), line=F.coalesce(_int("Line"), F.lit(0)))
    rows = _of(events, "Misc", "Bookmark").select("path", _int("Cycle").alias("cycle"), _int("BookmarkPoint").alias("point")).where("cycle is not null and point is not null")
    joined = rows.join(specs.withColumnRenamed("id", "point").withColumn("_known", F.lit(True)), ["path", "point"], "left")
    return joined.where("_known").select("path", "cycle", "point", "name", "file", "line"), joined.groupBy("path").agg(F.count_if(F.col("_known").isNull()).alias("unknown"))


def counters(events: DataFrame) -> DataFrame:
    """path, id, name, type, display_hint, values: the counters and how many values came."""
    specs = _last(_of(events, "Counters", "Spec"), _int("Id"), name=_str("Name"), type=F.coalesce(_int("Type"), F.lit(0)), display_hint=F.coalesce(_int("DisplayHint"), F.lit(0)))
    values = _of(events, "Counters", "SetValueInt", "SetValueFloat").groupBy("path", _int("CounterId").alias("id")).agg(F.count(F.lit(1)).alias("values"))
    return specs.join(values, ["path", "id"], "left").withColumn("values", F.coalesce("values", F.lit(0)))


def csv_stats(events: DataFrame) -> DataFrame:
    """path, id, name, kind, category: the CSV stats with the name of their category."""
    categories = _last(_of(events, "CsvProfiler", "RegisterCategory"), _int("Index"), category=_str("Name")).withColumnRenamed("id", "_category")
    rows = _of(events, "CsvProfiler", "DefineDeclaredStat", "DefineInlineStat")
    stats = _last(rows, _int("StatId"), name=_str("Name"), kind=F.when(F.col("name") == "DefineDeclaredStat", "declared").otherwise("inline"), _category=F.coalesce(_int("CategoryIndex"), F.lit(0)))
    return stats.join(categories, ["path", "_category"], "left").drop("_category")


def channels(events: DataFrame) -> DataFrame:
    """path, id, name, is_enabled, read_only of the announced channels."""
    flag = lambda name: F.coalesce(_int(name), F.lit(0)) != 0
    return _last(_of(events, "Trace", "ChannelAnnounce"), _int("Id"), name=_str("Name"), is_enabled=flag("IsEnabled"), read_only=flag("ReadOnly"))


def frame_marks(events: DataFrame) -> DataFrame:
    """path, tid, seq, type, cycle, d: begin and end marks of frames, for queue_pairs by path, tid and type."""
    rows = _of(events, "Misc", "BeginFrame", "EndFrame")
    return rows.select("path", "tid", "seq", F.coalesce(_int("FrameType"), F.lit(0)).alias("type"), _int("Cycle").alias("cycle"), F.when(F.col("name") == "BeginFrame", 1).otherwise(-1).alias("d")).where("cycle is not null")


def gpu_events(events: DataFrame) -> DataFrame:
    """path, tid, seq, kind, queue, spec, top, bop, cpu, other, number, draws, primitives for the operators of gpu."""
    rows = _of(events, GPU, *GPU_EVENTS)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in GPU_EVENTS.items() for x in pair]), F.col("name"))
    return rows.select(
        "path", "tid", "seq", kind.alias("kind"), _int("QueueId").alias("queue"), _int("SpecId").alias("spec"), F.coalesce(_int("GPUTimestampTOP"), _int("StartTime")).alias("top"), F.coalesce(_int("GPUTimestampBOP"), _int("EndTime")).alias("bop"),
        _int("CPUTimestamp").alias("cpu"), _int("QueueToWaitForId").alias("other"), _int("FrameNumber").alias("number"), _int("NumDraws").alias("draws"), _int("NumPrimitives").alias("primitives"),
    )


def task_events(events: DataFrame) -> DataFrame:
    """path, tid, seq, kind, task, other, stamp, size, text, execute_on, tracked for the operators of tasks.

    other of the begin of a wait is how many tasks it waits for.
    """
    rows = events.where((F.col("logger") == TASKS) & (F.col("name") != "Init"))
    waited = F.floor(F.length(F.try_element_at("bytes", F.lit("Tasks"))) / 8).cast("long")
    launched, sized = F.col("name") == "Launched", F.col("name").isin("Created", "Launched")
    made = rows.select(
        "path", "tid", "seq", F.col("name").alias("kind"), _int("TaskId").alias("task"), F.when(F.col("name") == "SubsequentAdded", _int("SubsequentId")).when(F.col("name") == "WaitingStarted", F.coalesce(waited, F.lit(0))).alias("other"), _int("Timestamp").alias("stamp"),
        F.when(sized, F.coalesce(_int("TaskSize"), F.lit(0))).alias("size"), F.when(launched, _str("DebugName")).alias("text"), F.when(launched, F.coalesce(_int("ThreadToExecuteOn"), F.lit(0))).alias("execute_on"), F.when(launched, F.coalesce(_int("Tracked"), F.lit(0)) != 0).alias("tracked"),
    )
    return made.where("stamp is not null and (task is not null or kind like 'Waiting%')")


def verified(events: DataFrame, anomalies: DataFrame) -> DataFrame:
    """path, errors, warnings, serials, missing, ok: whether a capture adds up. Warnings and missing serials do not fail it.

    serials are the 24-bit numbers that events carry, missing those of their extent that none does.
    """
    kinds = anomalies.groupBy("path").agg(F.count_if(~F.col("kind").isin(*WARNINGS)).alias("errors"), F.count_if(F.col("kind").isin(*WARNINGS)).alias("warnings"))
    carried = events.groupBy("path").agg(F.min("serial").alias("_low"), F.max("serial").alias("_high"), F.count("serial").alias("serials"))
    span = (F.col("_high") - F.col("_low")).bitwiseAND(F.lit(0xFFFFFF)) + 1
    joined = carried.join(kinds, "path", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings", "serials")})
    missing = F.greatest(F.lit(0), F.coalesce(span - F.col("serials"), F.lit(0)))
    return joined.select("path", "errors", "warnings", "serials", missing.alias("missing"), (F.col("errors") == 0).alias("ok"))


def packets_of(packets: DataFrame, tid: int | None = None) -> DataFrame:
    """path, form, packets, bytes, decoded: the packets by form, of one thread or of all."""
    rows = packets if tid is None else packets.where(F.col("tid") == tid)
    return rows.groupBy("path", "form").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.sum("decoded_size").alias("decoded"))
