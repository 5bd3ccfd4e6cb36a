"""Binary trace captures as a Spark data source, decoded from the published layout.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").option("table", "records").load(path)

Tables: info, packets, types, events, records (CPU begin and end records), gpu_records (of the older GPU channel) and
anomalies; every row has the path of its file. A file is `splits` input partitions (an option, 8 where not given), each
with the threads whose number falls to it, as order within a thread is meaning. The driver opens no file: a task walks the
packet headers through a memory map and touches the packets of its own threads only. What cannot be decoded is a row of
anomalies and stops its thread there, nothing is guessed.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the format
MAGIC, OLD_MAGIC, REFUSED = b"2CRT", b"TRC2", (b"ECRT", b"TRCE")
ENCODED, VERIFIED, TID_BITS = 0x8000, 0x4000, 0x3FFF
EVENTS, IMPORTANTS, PSEUDO_IMPORTANTS, SYNC = 0, 1, 0x3FFE, 0x3FFF
AUX, AUX_END, SCOPE_ENTER, SCOPE_LEAVE, LAST_TIMED_SCOPE, FIRST_USER = 1, 3, 4, 5, 9, 16
IMPORTANT, HAS_AUX, NO_SYNC = 1, 2, 4
FLOAT, ARRAY, STRING, SIGNED, SIZE = 0x40, 0x80, 0x08, 0x10, 0x03

PORT, SESSION, TRACE = 0, 1, 2  # fields of the header
#: Kinds of anomalies that do not mean that something could not be read.
WARNINGS = ("old-magic", "redefined")
SPLITS = 8

TABLES = {
    "info": "path string, magic string, size long, transport int, protocol int, port int, session string, trace string, packets long, threads int, lz4 long, raw long, verified long, sync long, payload long",
    "gpu_records": "path string, tid int, frame long, number long, base_us long, ord long, t long, spec long, d int, truncated boolean",
    "packets": "path string, index long, offset long, size int, tid int, form string, decoded_size int",
    "types": "path string, uid int, flags int, logger string, name string, full_name string, size int, fields array<struct<index int, name string, family int, offset int, size int, type_byte int, type_name string>>",
    "events": "path string, tid int, seq long, serial int, uid int, logger string, name string, whole map<string,bigint>, real map<string,double>, text map<string,string>, bytes map<string,binary>",
    "records": "path string, tid int, seq long, cycle long, spec long, d int",
    "anomalies": "path string, tid int, kind string, offset long, message string",
}


class CaptureError(ValueError):
    """A file that is not a capture this source reads."""


@dataclass
class EventType:
    uid: int
    flags: int
    logger: str
    name: str
    fields: list[tuple[str, int, int, int, int]]  # name, family, offset, size, type byte

    @property
    def size(self) -> int:
        return max((o + s for _, _, o, s, _ in self.fields), default=0)


@dataclass
class Capture:
    """A file's bytes with the places of its packets."""

    data: bytes | mmap.mmap
    at: int = 0
    packets: list[tuple[int, int, int, str, int]] = field(default_factory=list)  # offset, size, tid, form, decoded size
    anomalies: list[tuple[int, str, int, str]] = field(default_factory=list)

    @staticmethod
    def open(data: bytes | mmap.mmap) -> Capture:
        if len(data) < 12:
            raise CaptureError("the file is too short for a capture")
        magic = data[:4]
        if magic in REFUSED or magic not in (MAGIC, OLD_MAGIC):
            raise CaptureError(f"no capture begins with {magic!r}")
        made = Capture(data)
        if magic == OLD_MAGIC:
            made.anomalies.append((-1, "old-magic", 0, "read as the current layout"))
        made.at = 6 + struct.unpack_from("<H", data, 4)[0] + 2
        made._walk()
        return made

    def metadata(self) -> dict[int, bytes]:
        """The header's fields by id."""
        at, end, out = 6, self.at - 2, {}
        while at + 2 <= end:
            head = struct.unpack_from("<H", self.data, at)[0]
            out[head >> 8] = self.data[at + 2 : at + 2 + (head & 255)]
            at += 2 + (head & 255)
        return out

    def info(self) -> tuple:
        """One row of info, without the path."""
        held, forms = self.metadata(), [form for _, _, _, form, _ in self.packets]
        port = held.get(PORT, b"")
        guid = lambda at: held[at].hex() if at in held else None
        counts = [forms.count(f) for f in ("lz4", "raw", "verify", "sync")]
        return (self.data[:4].decode("ascii"), len(self.data), *self.versions(), struct.unpack("<H", port)[0] if len(port) == 2 else None, guid(SESSION), guid(TRACE), len(forms), len(self.threads()), *counts, sum(p[1] for p in self.packets))

    def versions(self) -> tuple[int, int]:
        """Transport and protocol."""
        return self.data[self.at - 2], self.data[self.at - 1]

    def _walk(self) -> None:
        at, data = self.at, self.data
        while at < len(data):
            if at + 4 > len(data):
                self.anomalies.append((-1, "packet", at, "the last header is cut"))
                return
            size, word = struct.unpack_from("<HH", data, at)
            head = 4 + 2 * bool(word & ENCODED)
            if size < head or at + size > len(data):
                self.anomalies.append((-1, "packet", at, f"a packet of {size} bytes cannot stand here"))
                return
            tid = word & TID_BITS
            form = "sync" if tid == SYNC else "lz4" if word & ENCODED else "verify" if word & VERIFIED else "raw"
            decoded = struct.unpack_from("<H", data, at + 4)[0] if word & ENCODED else size - 4
            self.packets.append((at, size, tid, form, decoded))
            at += size

    def threads(self) -> list[int]:
        return sorted({tid for _, _, tid, form, _ in self.packets if form != "sync"})

    def stream(self, tid: int) -> bytes:
        """A thread's bytes; a packet that cannot be decoded is left out and reported."""
        out = bytearray()
        for at, size, owner, form, decoded in self.packets:
            if owner != tid or form == "sync":
                continue
            if form == "lz4":
                block = self.data[at + 6 : at + size]
                if lz4_length(block) != decoded:
                    self.anomalies.append((tid, "lz4", at, f"the block does not give {decoded} bytes"))
                    continue
                out += pa.decompress(block, decoded, "lz4_raw", asbytes=True)
            else:
                out += self.data[at + 4 + 8 * (form == "verify") : at + size]
        return bytes(out)

    def types(self) -> dict[int, EventType]:
        """Declared event types by uid; a later declaration of a uid replaces the earlier one."""
        stream, at, out = self.stream(EVENTS), 0, {}
        while at + 4 <= len(stream):
            uid, size = struct.unpack_from("<HH", stream, at)
            body = stream[at + 4 : at + 4 + size]
            if len(body) < size or uid != 0:
                self.anomalies.append((EVENTS, "type", at, "no whole declaration stands here"))
                break
            at += 4 + size
            try:
                made = _event_type(body)
            except (struct.error, IndexError):
                self.anomalies.append((EVENTS, "type", at, "the declaration is cut"))
                break
            if made.uid in out:
                self.anomalies.append((EVENTS, "redefined", at, f"{made.logger}.{made.name}"))
            out[made.uid] = made
        return out


def _event_type(body: bytes) -> EventType:
    uid, count, flags, logger, name = struct.unpack_from("<HBBBB", body)
    names = 6 + 8 * count
    heads = [struct.unpack_from("<BBHHBB", body, 6 + 8 * i) for i in range(count)]
    at = names + logger + name
    fields = []
    for family, _, offset, size, kind, length in heads:  # the second byte is never written and may be anything
        if at + length > len(body):
            raise IndexError
        fields.append((body[at : at + length].decode("utf-8", "replace"), family, offset, size if family == 0 else 1 << (kind & SIZE), kind))
        at += length
    return EventType(uid, flags, body[names : names + logger].decode("utf-8", "replace"), body[names + logger : names + logger + name].decode("utf-8", "replace"), fields)


def type_name(kind: int) -> str:
    """The name of a type byte."""
    if kind & ARRAY:
        return ("WideString" if kind & SIZE else "AnsiString") if kind & STRING else "Array"
    bits = 8 << (kind & SIZE)
    if kind & FLOAT:
        return f"f{bits}"
    return "bool" if kind == 0 else f"{'i' if kind & SIGNED else 'u'}{bits}"


def lz4_length(block: bytes) -> int:
    """The bytes a raw LZ4 block gives, from its sequence lengths alone; -1 where the block is cut."""
    at, total, n = 0, 0, len(block)
    try:
        while at < n:
            token = block[at]
            at += 1
            literals = token >> 4
            if literals == 15:
                while True:
                    literals += block[at]
                    at += 1
                    if block[at - 1] != 255:
                        break
            at += literals
            total += literals
            if at == n:
                return total
            at += 2
            match = token & 15
            if match == 15:
                while True:
                    match += block[at]
                    at += 1
                    if block[at - 1] != 255:
                        break
            total += match + 4
    except IndexError:
        pass
    return -1


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, lowest first, and where the next thing begins."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number runs past its end")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def batch(blob: bytes) -> tuple[list[tuple[int, int | None, int]], str]:
    """(cycle or delta, spec, d) of each CPU record; a coroutine's has no spec. And what stopped it, if anything did."""
    out, at = [], 0
    try:
        while at < len(blob):
            head, at = varint(blob, at)
            begins, spec = head & 1, None
            if head & 2:
                for _ in range(1 + begins):
                    _, at = varint(blob, at)
            elif begins:
                spec, at = varint(blob, at)
            out.append((head >> 2, spec, 1 if begins else -1))
    except ValueError as e:
        return out, str(e)
    return out, ""


def absolute(values: list[int], before: int = 0) -> list[int]:
    """Cycles of a thread's records: a value below the last cycle is the distance from it."""
    out = []
    for v in values:
        before = before + v if v < before else v
        out.append(before)
    return out


def _values(kind: EventType, payload: bytes, aux: dict[int, bytes], important: bool) -> tuple[dict, dict, dict, dict]:
    whole, real, text, raw = {}, {}, {}, {}
    for index, (name, _, offset, _, byte) in enumerate(kind.fields):
        if byte & ARRAY:
            data = aux.get(index)
            if byte & STRING:
                if data is not None:
                    wide = bool(byte & SIZE) and not important
                    text[name] = data.decode("utf-16-le" if wide else "utf-8", "replace").rstrip("\0")
            else:
                raw[name] = data or b""
            continue
        size = 1 << (byte & SIZE)
        if offset + size > len(payload):
            continue  # absent, not zero
        data = payload[offset : offset + size]
        if byte & FLOAT:
            real[name] = struct.unpack("<f" if size == 4 else "<d", data)[0]
        else:
            number = int.from_bytes(data, "little", signed=bool(byte & SIGNED))
            whole[name] = number if number < 2**63 else number - 2**64
    return whole, real, text, raw


def events(capture: Capture, tid: int, types: dict[int, EventType]) -> Iterator[tuple]:
    """Rows of one thread in stream order: seq, serial, type and values; scope markers have no type and are left out."""
    stream = capture.stream(tid)
    reader = _important_events if tid == IMPORTANTS else _thread_events
    for seq, (uid, serial, payload, aux) in enumerate(reader(capture, tid, stream, types)):
        yield seq, serial, types[uid], _values(types[uid], payload, aux, tid == IMPORTANTS)


def _important_events(capture: Capture, tid: int, stream: bytes, types: dict[int, EventType]) -> Iterator[tuple]:
    at = 0
    while at + 4 <= len(stream):
        uid, size = struct.unpack_from("<HH", stream, at)
        record = stream[at + 4 : at + 4 + size]
        if len(record) < size:
            capture.anomalies.append((tid, "cut", at, "the record runs past the stream"))
            return
        at += 4 + size
        kind = types.get(uid)
        if kind is None:
            capture.anomalies.append((tid, "unknown-uid", at, str(uid)))
            continue
        inside, aux = kind.size, {}
        while kind.flags & HAS_AUX and inside + 4 <= len(record) and record[inside] == AUX:
            packed, upper = struct.unpack_from("<BH", record, inside + 1)
            length = upper << 3 | packed >> 5
            aux[packed & 31] = aux.get(packed & 31, b"") + record[inside + 4 : inside + 4 + length]
            inside += 4 + length
            if record[inside : inside + 1] == bytes((AUX_END,)):
                inside += 1
        yield uid, None, record[: kind.size], aux


def _thread_events(capture: Capture, tid: int, stream: bytes, types: dict[int, EventType]) -> Iterator[tuple]:
    at, n = 0, len(stream)
    while at < n:
        start = at
        if stream[at] & 1:
            if at + 2 > n:
                break
            uid, at = struct.unpack_from("<H", stream, at)[0] >> 1, at + 2
        else:
            uid, at = stream[at] >> 1, at + 1
        if SCOPE_ENTER <= uid <= LAST_TIMED_SCOPE:
            at = at if uid <= SCOPE_LEAVE else start + 8
            continue
        kind = types.get(uid)
        if kind is None:
            capture.anomalies.append((tid, "unknown-uid", start, str(uid)))
            return
        serial = None
        if not kind.flags & NO_SYNC:
            serial, at = int.from_bytes(stream[at : at + 3], "little"), at + 3
        payload, at = stream[at : at + kind.size], at + kind.size
        aux: dict[int, bytes] = {}
        while kind.flags & HAS_AUX and at < n and stream[at] != AUX_END << 1:
            if stream[at] != AUX << 1 or at + 4 > n:
                at = n + 1
                break
            packed, upper = struct.unpack_from("<BH", stream, at + 1)
            length = upper << 3 | packed >> 5
            aux[packed & 31] = aux.get(packed & 31, b"") + stream[at + 4 : at + 4 + length]
            at += 4 + length
        at += bool(kind.flags & HAS_AUX)
        if at > n:
            capture.anomalies.append((tid, "cut", start, f"{kind.logger}.{kind.name} runs past the stream"))
            return
        yield uid, serial, payload, aux


def records(capture: Capture, tid: int, types: dict[int, EventType]) -> Iterator[tuple[int, int, int, int | None, int]]:
    """CPU records of one thread: (tid, seq, cycle, spec, d); the cycle carries on from batch to batch."""
    last, seq = 0, 0
    for _, _, kind, (_, _, _, raw) in events(capture, tid, types):
        if kind.logger != "CpuProfiler" or not kind.name.startswith("EventBatch"):
            continue
        found, why = batch(raw.get("Data", b""))
        if why:
            capture.anomalies.append((tid, "batch", seq, why))
        for cycle, (_, spec, d) in zip(absolute([v for v, _, _ in found], last), found, strict=True):
            yield tid, seq, cycle, spec, d
            seq += 1
            last = cycle


def gpu_frame(blob: bytes, base_us: int) -> tuple[list[tuple[int, int | None, int]], bool]:
    """(time in microseconds, spec, d) of each record of a frame of the older GPU channel, and whether it is cut."""
    out, at, t = [], 0, base_us
    while at < len(blob):
        try:
            head, at = varint(blob, at)
        except ValueError:
            return out, True
        t += head >> 1
        spec = None
        if head & 1:
            if at + 4 > len(blob):
                return out, True
            spec, at = struct.unpack_from("<I", blob, at)[0], at + 4
        out.append((t, spec, 1 if head & 1 else -1))
    return out, False


def gpu_records(capture: Capture, tid: int, types: dict[int, EventType]) -> Iterator[tuple]:
    """tid, frame, number, base_us, ord, t, spec, d, truncated: a frame without records has one row with null d."""
    frame = 0
    for _, _, kind, (whole, _, _, raw) in events(capture, tid, types):
        if kind.logger != "GpuProfiler" or kind.name != "Frame":
            continue
        if "Data" not in raw:
            capture.anomalies.append((tid, "batch", frame, "a frame carries no data"))
            continue
        base, number = whole.get("TimestampBase", 0), whole.get("RenderingFrameNumber", 0)
        found, cut = gpu_frame(raw["Data"], base)
        for ord_, (t, spec, d) in enumerate(found or [(base, None, None)]):
            yield tid, frame, number, base, ord_, t, spec, d, cut
        frame += 1


@dataclass
class _Part(InputPartition):
    path: str
    split: int
    splits: int


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, splits: int) -> None:
        self.paths, self.table, self.splits = paths, table, splits

    def partitions(self) -> list[_Part]:
        splits = 1 if self.table in ("info", "packets", "types") else self.splits
        return [_Part(p, i, splits) for p in self.paths for i in range(splits)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for row in self._rows(part):
            yield part.path, *row

    def _rows(self, part: _Part) -> Iterator[tuple]:
        capture = Capture.open(_bytes(part.path))
        if self.table == "packets":
            yield from ((i, at, size, tid, form, decoded) for i, (at, size, tid, form, decoded) in enumerate(capture.packets))
            return
        if self.table == "info":
            yield capture.info()
            return
        types = capture.types()
        if self.table == "types":
            for t in types.values():
                fields = [(i, n, f, o, s, k, type_name(k)) for i, (n, f, o, s, k) in enumerate(t.fields)]
                yield t.uid, t.flags, t.logger, t.name, f"{t.logger}.{t.name}", t.size, fields
            return
        if self.table == "anomalies" and part.split == 0:
            yield from capture.anomalies
        capture.anomalies.clear()
        for tid in capture.threads():
            if tid == EVENTS or tid % part.splits != part.split:
                continue
            if self.table == "records":
                yield from records(capture, tid, types)
            elif self.table == "gpu_records":
                yield from gpu_records(capture, tid, types)
            elif self.table == "events":
                for seq, serial, kind, (whole, real, text, raw) in events(capture, tid, types):
                    yield tid, seq, serial, kind.uid, kind.logger, kind.name, whole, real, text, raw
            else:
                for _ in records(capture, tid, types):
                    pass
                yield from capture.anomalies
                capture.anomalies.clear()


def _bytes(path: str) -> bytes | mmap.mmap:
    """A file's bytes: mapped where it is local, so that only what is looked at is read; else from the file system of its URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as file:
            return file.readall()
    with open(path, "rb") as file:
        if os.fstat(file.fileno()).st_size == 0:
            return b""
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


class CaptureSource(DataSource):
    """The data source 'capture': option table chooses the rows, load() takes a path or several joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        table = self.options.get("table", "events")
        if table not in TABLES:
            raise CaptureError(f"no table {table!r}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader([p for p in self.options["path"].split(",") if p], self.options.get("table", "events"), int(self.options.get("splits", SPLITS)))
