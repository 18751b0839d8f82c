import json
import zlib

import numpy as np
import pytest

from kinelake import sources
from kinelake.sources import avro


def number(n):
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def text(s):
    return number(len(s.encode())) + s.encode()


def numbers(values, sized=False):
    """An array of numbers in two blocks, the first with its size if asked."""
    first, rest = [number(v) for v in values[:3]], [number(v) for v in values[3:]]
    out = (number(-len(first)) + number(sum(map(len, first))) if sized else number(len(first))) + b"".join(first) if first else b""
    return out + (number(len(rest)) + b"".join(rest) if rest else b"") + number(0)


def reals(values):
    return (number(len(values)) + np.array(values, "<f4").tobytes() if values else b"") + number(0)


IMU = {"type": "record", "name": "Imu", "fields": [{"name": f, "type": "int"} for f in ("physicalMin", "physicalMax", "digitalMin", "digitalMax")]}


def stream(name, *fields):
    head = [{"name": "timestampStart", "type": "long"}, {"name": "samplingFrequency", "type": "float"}]
    return {"name": name, "type": {"type": "record", "name": name.capitalize(), "namespace": "wrist.raw", "fields": [*head, *fields]}}


ARRAY = lambda kind: {"type": "array", "items": kind}
AXES = [{"name": a, "type": ARRAY("int")} for a in "xyz"]
SCHEMA = {
    "type": "record", "name": "Record", "namespace": "wrist",
    "fields": [
        {"name": "timezone", "type": ["null", "int"]}, {"name": "deviceSn", "type": "string"},
        {"name": "rawData", "type": {"type": "record", "name": "Raw", "fields": [
            stream("accelerometer", {"name": "imuParams", "type": IMU}, *AXES), stream("gyroscope", {"name": "imuParams", "type": "Imu"}, *AXES),
            stream("eda", {"name": "values", "type": ARRAY("float")}), stream("temperature", {"name": "values", "type": ARRAY("float")}), stream("bvp", {"name": "values", "type": ARRAY("float")}),
            {"name": "systolicPeaks", "type": {"type": "record", "name": "Peaks", "fields": [{"name": "peaksTimeNanos", "type": ARRAY("long")}]}},
            stream("steps", {"name": "values", "type": ARRAY("int")}),
        ]}},
    ],
}


def written(path, codec="null", records=2, zone=3600, n=80):
    imu = b"".join(map(number, (-16, 16, -32768, 32768)))
    single = lambda f: np.array([f], "<f4").tobytes()
    start = number(1_700_000_000_000_000)
    x = [-2048 * k for k in range(n)]
    body = number(1) + number(zone) + text("S1")
    body += start + single(64.0) + imu + numbers(x, True) + numbers([2048] * n) + numbers([0] * n)
    body += start + single(64.0) + imu + numbers([]) * 3
    body += start + single(4.0) + reals([0.5, 1.5, 2.5, 3.5, 4.5])
    body += start + single(1.0) + reals([30.0, 31.0]) + start + single(64.0) + reals([])
    body += numbers([1_700_000_000_500_000_000, 1_700_000_001_000_000_000])
    body += start + single(0.2) + numbers([7])
    block = body * records
    packed = {"null": block, "deflate": zlib.compress(block)[2:-4]}.get(codec, block)
    meta = number(2) + text("avro.schema") + text(json.dumps(SCHEMA)) + text("avro.codec") + text(codec) + number(0)
    sync = bytes(range(16))
    path.write_bytes(avro.MAGIC + meta + sync + number(records) + number(len(packed)) + packed + sync)
    return np.array(x) / 2048


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_records(tmp_path, codec):
    path = tmp_path / "a.avro"
    written(path, codec)
    got = list(avro.records(str(path)))
    assert len(got) == 2 and got[0]["timezone"] == 3600 and got[1]["deviceSn"] == "S1"
    raw = got[0]["rawData"]
    assert raw["accelerometer"]["x"].tolist() == [-2048 * k for k in range(80)] and raw["gyroscope"]["y"].tolist() == []
    assert raw["eda"]["values"].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5] and raw["systolicPeaks"]["peaksTimeNanos"].tolist() == [1_700_000_000_500_000_000, 1_700_000_001_000_000_000]


def test_numbers_of_every_size():
    values = [0, -1, 1, 63, -64, 64, 2**31, -(2**31), 2**62, -(2**63), 2**63 - 1]
    d = avro.Decoder(b"".join(number(v) for v in values) + b"rest")
    assert d.longs(len(values)).tolist() == values and d.take(4) == b"rest"
    with pytest.raises(ValueError):
        avro.Decoder(b"\x80").longs(1)


def test_other_types():
    schema = [{"type": "enum", "name": "E", "symbols": ["a", "b"]}, {"type": "map", "values": "double"}, {"type": "fixed", "name": "F", "size": 2}, "boolean", "bytes"]
    names = avro._named(schema, {})
    assert avro.Decoder(number(0) + number(1)).value(schema, names) == "b"
    assert avro.Decoder(number(1) + number(1) + text("k") + np.array([1.5]).tobytes() + number(0)).value(schema, names) == {"k": 1.5}
    assert avro.Decoder(number(2) + b"xy").value(schema, names) == b"xy" and avro.Decoder(number(3) + b"\1").value(schema, names) is True
    with pytest.raises(ValueError):
        avro.Decoder(b"").value("nothing", {})


def test_source(spark, tmp_path):
    sources.register(spark)
    x = written(tmp_path / "a.avro")
    written(tmp_path / "b.avro", "deflate", zone=0)
    df = spark.read.format("empatica").option("path", str(tmp_path)).load()
    got = df.toPandas()
    assert got.recording_id.nunique() == 2 and df.rdd.getNumPartitions() == 2
    a = got[got.recording_id.str.endswith("a.avro")]
    assert a.groupby("stream").size().to_dict() == {"accel": 80, "eda": 5, "temperature": 2, "systolic_peaks": 2, "steps": 1}
    accel = a[a.stream == "accel"].sort_values("sample_idx")
    assert np.allclose(accel.x, x) and np.allclose(accel.y, 1.0) and np.allclose(accel.t, 1.7e9 + 3600 + np.arange(80) / 64)
    assert np.allclose(a[a.stream == "systolic_peaks"].t, [1.7e9 + 3600.5, 1.7e9 + 3601]) and a[a.stream == "systolic_peaks"].fs.isna().all()
    utc = spark.read.format("empatica").option("path", str(tmp_path / "a.avro")).option("local", "false").load()
    assert utc.agg({"t": "min"}).first()[0] == 1.7e9
    together = avro.on_accelerometer(df).filter("recording_id like '%a.avro'").orderBy("sample_idx").toPandas()
    assert len(together) == 80 and np.allclose(together.temperature[:65], 30 + np.arange(65) / 64) and np.allclose(together.eda[:64], 0.5 + np.arange(64) / 16)
    assert together.temperature[79] == 31.0


def test_damaged_files(tmp_path):
    (tmp_path / "a.avro").write_bytes(b"x" * 2000)
    with pytest.raises(ValueError):
        list(avro.records(str(tmp_path / "a.avro")))
    written(tmp_path / "b.avro")
    data = bytearray((tmp_path / "b.avro").read_bytes())
    data[-1] ^= 1
    (tmp_path / "b.avro").write_bytes(data)
    with pytest.raises(ValueError):
        list(avro.records(str(tmp_path / "b.avro")))
    written(tmp_path / "c.avro", "snappy")
    with pytest.raises(ValueError):
        list(avro.records(str(tmp_path / "c.avro")))
