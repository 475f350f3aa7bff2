"""Files of change records in the binary replication format, as a batch source and sink named `records`.

A record is a header of 312 bytes and, for some types, a payload. The byte order is that of the first record. Every
record but the first carries a running checksum of all bytes before that field.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from shalebed.functions.payloads import ZERO, fletcher4_update

#: Fixed values of the format: record types by number, the magic number, and each type's fields after the first eight bytes.
TYPES = "BEGIN OBJECT FREEOBJECTS WRITE FREE END WRITE_BYREF SPILL WRITE_EMBEDDED OBJECT_RANGE REDACT".split()
MAGIC = 0x2F5BACBAC
HEADER = 312
LAYOUT = {
    "BEGIN": ("QQQIIQQ256s", "magic version created objset flags toguid fromguid toname"),
    "OBJECT": ("QIIIIBBBBIQBBB5xQ", "object objtype bonustype blksz bonuslen checksum compress slots flags rawlen toguid shift levels nblkptr maxblkid"),
    "FREEOBJECTS": ("QQQ", "object length toguid"),
    "WRITE": ("QI4xQQQBBB5x40xQ", "object objtype offset length toguid checksum flags compress csize"),
    "FREE": ("QQQQ", "object offset length toguid"),
    "END": ("QQQQQ", "a b c d toguid"),
    "WRITE_BYREF": ("QQQQQQQBB", "object offset length toguid ref_guid ref_object ref_offset checksum flags"),
    "SPILL": ("QQQBB6xQ", "object length toguid flags compress csize"),
    "WRITE_EMBEDDED": ("QQQQBB6xII", "object offset length toguid compress etype lsize psize"),
    "OBJECT_RANGE": ("QQQ", "object length toguid"),
    "REDACT": ("QQQQ", "object offset length toguid"),
}
#: Columns that rows carry; other fields of a record are zero when written.
COLUMNS = "toguid fromguid object offset length ref_guid ref_object ref_offset objtype compress csize flags".split()
SCHEMA = "file string, seq long, at long, type string, toname string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", payload binary"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _payload_size(kind: str, f: dict[str, int], begin: int) -> int:
    """Bytes after the header, by the type's own length fields; bonus and embedded data fill whole eights."""
    if kind == "BEGIN":
        return begin
    if kind == "OBJECT":
        return f["rawlen"] or -(-f["bonuslen"] // 8) * 8
    if kind in ("WRITE", "SPILL"):
        return f["csize"] or f["length"]
    return -(-f["psize"] // 8) * 8 if kind == "WRITE_EMBEDDED" else 0


def parse(stream, name: str, check: bool = True) -> Iterator[tuple]:
    """Rows of an open file, one record in memory at a time.

    ValueError for a cut or foreign file, an unknown type, BEGIN or END out of place, or (with check) a wrong checksum.
    """
    order, at, seq, sums, inside = None, 0, 0, ZERO, False
    while head := stream.read(HEADER):
        if len(head) < HEADER:
            raise ValueError(f"{name}: record cut at byte {at}")
        if order is None:
            order = next((o for o in "<>" if struct.unpack_from(o + "Q", head, 8)[0] == MAGIC), None)
            if order is None:
                raise ValueError(f"{name}: no magic number")
        number, begin = struct.unpack_from(order + "II", head)
        if number >= len(TYPES):
            raise ValueError(f"{name}: type {number} at byte {at}")
        kind = TYPES[number]
        if inside == (kind == "BEGIN"):
            raise ValueError(f"{name}: {kind} out of place at byte {at}")
        inside = kind != "END"
        form, names = LAYOUT[kind]
        f = dict(zip(names.split(), struct.unpack_from(order + form, head, 8)))
        payload = stream.read(size) if (size := _payload_size(kind, f, begin)) else None
        if size and len(payload) < size:
            raise ValueError(f"{name}: payload cut at byte {at + HEADER}")
        if kind == "BEGIN":
            sums = ZERO
        elif check and kind == "END" and (f["a"], f["b"], f["c"], f["d"]) != sums:
            raise ValueError(f"{name}: wrong checksum of the stream at byte {at}")
        if check:
            sums = fletcher4_update(sums, head[: HEADER - 32], order)
            stored = struct.unpack_from(order + "4Q", head, HEADER - 32)
            if kind != "BEGIN" and any(stored) and stored != sums:
                raise ValueError(f"{name}: wrong checksum at byte {at}")
            sums = fletcher4_update(sums, head[HEADER - 32 :] + (payload or b""), order)
        toname = f["toname"].split(b"\0")[0].decode("utf-8", "replace") if kind == "BEGIN" else None
        yield (name, seq, at, kind, toname, *(_signed(f[c]) if c in f else None for c in COLUMNS), payload)
        at += HEADER + size
        seq += 1
    if inside:
        raise ValueError(f"{name}: no END")


def pack(rows: Iterator) -> Iterator[bytes]:
    """Records of rows in order (type and any of COLUMNS, toname, payload), little-endian, with running checksums."""
    sums = ZERO
    for row in rows:
        r = row.asDict()
        kind, payload = r["type"], bytes(r.get("payload") or b"")
        form, names = LAYOUT[kind]
        values = {n: (r.get(n) or 0) % (1 << 64) for n in names.split() if n in COLUMNS}
        if kind == "BEGIN":
            sums = ZERO
            values |= {"magic": MAGIC, "version": 1, "toname": (r.get("toname") or "").encode()[:255]}
        elif kind == "END":
            values |= dict(zip("abcd", sums))
        elif kind == "OBJECT":
            values["bonuslen"] = len(payload)
        elif kind == "WRITE_EMBEDDED":
            values["psize"] = len(payload)
        elif kind in ("WRITE", "SPILL"):
            values["csize"] = len(payload) if len(payload) != values["length"] else 0
        if kind in ("OBJECT", "WRITE_EMBEDDED"):
            payload += bytes(-len(payload) % 8)
        head = struct.pack("<II", TYPES.index(kind), len(payload) if kind == "BEGIN" else 0)
        head += struct.pack("<" + form, *(values.get(n, 0) for n in names.split()))
        # The name in BEGIN reaches over the checksum's place.
        head += bytes(max(0, HEADER - 32 - len(head)))
        sums = fletcher4_update(sums, head)
        own = b"" if kind == "BEGIN" else struct.pack("<4Q", *sums)
        sums = fletcher4_update(sums, own + payload)
        yield head + own
        yield payload


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.check = options["path"], options.get("checksum", "true") == "true"

    def partitions(self) -> list[_File]:
        if "://" in self.path:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(self.path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                scheme = self.path.split("://")[0]
                return [_File(f"{scheme}://{x.path}") for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File]
            return [_File(self.path)]
        found = sorted(glob.glob(f"{self.path}/*" if os.path.isdir(self.path) else self.path))
        return [_File(x) for x in found if not os.path.basename(x).startswith(("_", "."))]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # nothing was found
            return
        if "://" in partition.path:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(partition.path)
            with store.open_input_stream(inner) as stream:
                yield from parse(stream, partition.path, self.check)
        else:
            with open(partition.path, "rb") as stream:
                yield from parse(stream, partition.path, self.check)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """One file for each partition, renamed when all are whole: a task that is run twice leaves one file."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        temporary = f"{self.path}/_part-{part}-{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for piece in pack(rows):
                out.write(piece)
        return _Written(temporary, f"{self.path}/part-{part:05d}.rec")

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m]
        if self.overwrite:
            for old in glob.glob(f"{self.path}/part-*.rec"):
                os.remove(old)
        for m in done:
            if os.path.getsize(m.temporary):
                os.replace(m.temporary, m.final)
            else:
                os.remove(m.temporary)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


class RecordSource(DataSource):
    """`spark.read.format("records").load(path)`: a file, a folder or a pattern; option checksum=false skips the checks.

    Written partitions must each be a whole stream from BEGIN to END in order; the folder must be one that all tasks share.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
