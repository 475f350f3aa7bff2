import struct

import pytest
from pyspark.sql import functions as F

from shalebed.functions.payloads import ZERO, fletcher4_combine, fletcher4_update
from shalebed.sources import records

ROWS = [
    ("BEGIN", 7, None, None, None, None, None, None, None, "tank/fs@a"),
    ("OBJECT", 7, 3, None, None, None, None, None, b"bonus", None),
    ("WRITE", 7, 3, 0, 8, None, None, None, b"12345678", None),
    ("WRITE", 7, 3, 8, 100, None, None, None, b"packed", None),
    ("WRITE_BYREF", 7, 3, 108, 8, 7, 3, 0, None, None),
    ("WRITE_EMBEDDED", 7, 3, 200, 5, None, None, None, b"tiny!", None),
    ("FREE", 7, 3, 300, -1, None, None, None, None, None),
    ("FREEOBJECTS", 7, 9, None, 4, None, None, None, None, None),
    ("REDACT", 7, 3, 400, 4, None, None, None, None, None),
    ("END", 7, None, None, None, None, None, None, None, None),
]
SCHEMA = "type string, toguid long, object long, offset long, length long, ref_guid long, ref_object long, ref_offset long, payload binary, toname string"


@pytest.fixture
def folder(spark, tmp_path):
    records.register(spark)
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("records").mode("append").save(str(tmp_path))
    return tmp_path


def test_round_trip(spark, folder):
    got = spark.read.format("records").load(str(folder)).orderBy("seq").collect()
    assert [r["type"] for r in got] == [r[0] for r in ROWS]
    assert [bytes(r["payload"]).rstrip(b"\0") if r["payload"] else None for r in got] == [r[8] for r in ROWS]
    assert [r["offset"] for r in got][2:7] == [0, 8, 108, 200, 300]
    assert got[0]["toname"] == "tank/fs@a" and got[4]["ref_object"] == 3 and got[6]["length"] == -1
    assert got[1]["at"] == records.HEADER


def test_overwrite_and_empty(spark, folder):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.coalesce(1).write.format("records").mode("overwrite").save(str(folder))
    assert spark.read.format("records").load(str(folder)).count() == len(ROWS)
    df.where(F.lit(False)).write.format("records").mode("overwrite").save(str(folder))
    assert spark.read.format("records").load(str(folder)).count() == 0


def _whole(folder):
    return next(folder.glob("*.rec")).read_bytes()


@pytest.mark.parametrize("damage", ["payload", "cut", "foreign", "type", "no end", "no begin"])
def test_damage_is_found(spark, folder, damage):
    import io

    raw = _whole(folder)
    end = len(raw) - records.HEADER
    bad = {
        "payload": raw.replace(b"12345678", b"12345679"), "cut": raw[:-1], "foreign": b"x" * 400, "type": raw[:end] + struct.pack("<I", 77) + raw[end + 4 :],
        "no end": raw[:end], "no begin": raw[records.HEADER :],
    }[damage]
    with pytest.raises(ValueError):
        list(records.parse(io.BytesIO(bad), "x"))


def test_other_byte_order():
    import io

    head = struct.pack(">II", 0, 0) + struct.pack(">QQQIIQQ256s", records.MAGIC, 1, 0, 0, 0, 5, 0, b"n")
    begin = head + bytes(records.HEADER - len(head))
    sums = fletcher4_update(ZERO, begin, ">")
    end = struct.pack(">II5Q", 5, 0, *sums, 5)
    end += bytes(records.HEADER - 32 - len(end))
    end += struct.pack(">4Q", *fletcher4_update(sums, end, ">"))
    assert [r[3] for r in records.parse(io.BytesIO(begin + end), "x")] == ["BEGIN", "END"]


def test_combined_checksums():
    data = bytes(range(256)) * 5
    for cut in (0, 4, 400, 1280):
        left, right = fletcher4_update(ZERO, data[:cut]), fletcher4_update(ZERO, data[cut:])
        assert fletcher4_combine(left, right, (len(data) - cut) // 4) == fletcher4_update(ZERO, data)
