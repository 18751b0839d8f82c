import struct

import numpy as np
import pytest

from kinelake import sources
from kinelake.sources import binary, tables
from kinelake.streaming import epochs


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    stamps = [f"2024-03-01 00:00:{s:02d}" for s in range(5) for _ in range(4)]
    path.write_text("ts,x,y,z\n" + "\n".join(f"{t},{9.81 * i},0,9.81" for i, t in enumerate(stamps)))
    got = tables.read_csv(spark, str(path), "ts", {"x": "ax", "y": "ay", "z": "az", "none": "temperature"}, repeated="spread", accel_in_g=False).orderBy("sample_idx").toPandas()
    assert np.allclose(np.diff(got.t), 0.25) and np.allclose(got.ax, np.arange(20)) and "temperature" not in got
    gap = tmp_path / "b.csv"
    gap.write_text("t,az\n" + "\n".join(f"{t},1.5" for t in (0, 1, 2, 6, 7)))
    filled = tables.read_csv(spark, str(gap), "t", {"az": "az"}, step=1.0).orderBy("sample_idx").toPandas()
    assert filled["az"].tolist() == [1.5, 1.5, 1.5, 1.0, 1.0, 1.0, 1.5, 1.5]
    with pytest.raises(tables.GapError):
        tables.read_csv(spark, str(gap), "t", {"az": "az"}, step=1.0, on_gap="raise")
    tables.write_results(got_df := spark.createDataFrame([(1, 2.0)], "day_n int, v double"), str(tmp_path / "out"), {"file": "a"}, ["day_n"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out/results")).count() == got_df.count()


def block(sequence, samples, fs_code=10):
    """One data block of unpacked three-axis samples at 2^(8+0) counts a g."""
    stamp = (24 << 26) | (3 << 22) | (1 << 17) | (2 << 12) | (3 << 6) | sequence
    body = struct.pack("<2sHHIIIHHBBBBhH", b"AX", 508, 0, 1, sequence, stamp, 0, 171 + 63, 0, 100, fs_code, 0x32, 0, len(samples))
    body += b"".join(struct.pack("<3h", *s) for s in samples)
    body = body.ljust(510, b"\0")
    total = int(np.frombuffer(body, "<u2").sum(dtype=np.uint64)) & 0xFFFF
    return body + struct.pack("<H", (-total) & 0xFFFF)


def test_cwa(spark, tmp_path):
    path = tmp_path / "a.cwa"
    values = [(256, -128, i) for i in range(80)]
    good, bad = block(0, values), bytearray(block(1, values))
    bad[40] ^= 1
    path.write_bytes(b"MD".ljust(1024, b"\0") + good + bytes(bad) + block(2, values))
    sources.register(spark)
    got = spark.read.format("cwa").option("path", str(path)).load().orderBy("sample_idx").toPandas()
    assert len(got) == 160 and got.sample_idx.tolist() == [*range(80), *range(160, 240)]
    assert np.allclose(got.ax, 1) and np.allclose(got.ay, -0.5) and np.isclose(got.t[1] - got.t[0], 0.01)
    assert np.isclose(got.temperature[0], 63 / 3.142)
    packed = np.array([(1 << 30) | (5 << 20) | (1023 << 10) | 512], np.uint32)
    assert binary.three_axes(packed).tolist() == [[-1024, -2, 10]]


def test_geneactiv(spark, tmp_path):
    path = tmp_path / "a.bin"
    sample = f"{(100 << 36) | ((4096 - 100) << 24) | (50 << 12) | (40 << 2):012X}"
    header = ["Calibration Data"] + [f"{a} {k}:{v}" for a in "xyz" for k, v in (("gain", 25000), ("offset", 0))] + ["Volts:300", "Lux:900"]
    page = ["Recorded Data", "Sequence Number:1", "Page Time:2024-03-01 00:00:00:500", "Temperature:21.5", "Measurement Frequency:50.0", sample * 300]
    path.write_text("\n".join(header + page))
    got = spark.read.format("geneactiv").option("path", str(path)).load().toPandas() if sources.register(spark) is None else None
    assert len(got) == 300 and np.allclose(got.ax, 0.4) and np.allclose(got.ay, -0.4) and np.allclose(got.light, 120) and got.sample_idx.min() == 300 and np.isclose(got.temperature[0], 21.5)


def test_npz(spark, tmp_path):
    path = tmp_path / "a.npz"
    np.savez(path, time=np.arange(200.0), accel=np.ones((200, 3)), temperature=np.full(200, 30.0))
    sources.register(spark)
    got = spark.read.format("npz").option("path", str(path)).load()
    assert got.count() == 200 and got.agg({"temperature": "avg"}).first()[0] == 30.0
    np.savez(tmp_path / "b.npz", time=np.arange(200.0))
    with pytest.raises(Exception, match="lacks time or accel"):
        spark.read.format("npz").option("path", str(tmp_path / "b.npz")).load().count()


def test_file_checks(tmp_path):
    small = tmp_path / "a.cwa"
    small.write_bytes(b"x")
    with pytest.raises(binary.FileSizeError):
        binary.checked(str(small), (".cwa",))
    assert not binary.checked(str(small), (".cwa",), skip_small=True)
    with pytest.raises(FileNotFoundError):
        binary.checked(str(tmp_path / "none"), (".cwa",))
    with pytest.raises(ValueError):
        binary.checked(None, (".cwa",))
    with pytest.raises(ValueError):
        binary.checked(str(small), (".bin",), on_suffix="raise")


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", 2.0, 0.0, 0.0) for s in range(20)] + [(1, f"2024-01-01 00:01:{s:02d}", 0.0, 0.0, 1.0) for s in range(0, 60, 10)] + [(1, "2024-01-01 00:20:00", 2.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "recording_id long, ts string, ax double, ay double, az double").selectExpr("recording_id", "cast(ts as timestamp) ts", "ax", "ay", "az")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, f in (("e", epochs.epoch_stream(stream)), ("m", epochs.moving_stream(stream, "10 seconds", "5 seconds")), ("b", epochs.bout_stream(stream))):
        q = f.writeStream.format("memory").queryName(f"stream_{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    e = spark.table("stream_e").orderBy("start").toPandas()
    assert e.samples.tolist()[:4] == [5, 5, 5, 5] and np.allclose(e.en[:4], 2) and np.allclose(e.enmo[4:], 0)
    assert spark.table("stream_b").first().samples == 20 and spark.table("stream_m").count() > 4
