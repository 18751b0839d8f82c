"""Avro container files in Python, and wristband recordings kept in them as a data source.

Numbers of an array are decoded together; a file is one partition, so a folder of
recordings is read by as many tasks.
"""

from __future__ import annotations

import bz2
import glob
import json
import lzma
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from kinelake.functions.axes import physical
from kinelake.operators.kernels import low_passed
from kinelake.operators.timeline import interpolated_at
from kinelake.operators.windows import KEY
from kinelake.sources.binary import Range, checked

MAGIC = b"Obj\x01"


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


CODECS = {"null": bytes, "deflate": lambda d: zlib.decompress(d, -15), "bzip2": bz2.decompress, "xz": lzma.decompress, "zstandard": _unzstd}


class Decoder:
    """Reads values of a schema from bytes, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.bytes, self.at = data, np.frombuffer(data, np.uint8), 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data end within a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        value, shift = 0, 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def longs(self, count: int) -> np.ndarray:
        """The next `count` numbers of variable size."""
        part = self.bytes[self.at : self.at + 10 * count]
        stop = np.flatnonzero(part < 128)[:count]
        if len(stop) < count:
            raise ValueError("the data end within an array")
        start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
        size, value = stop - start + 1, np.zeros(count, np.uint64)
        for k in range(int(size.max(initial=0))):
            more = size > k
            value[more] |= (part[start[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
        self.at += int(stop[-1]) + 1 if count else 0
        return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)

    def items(self, kind, names: dict):
        """An array's items; numbers come as a numpy array."""
        kind = names.get(kind, kind) if isinstance(kind, str) else kind
        plain = kind["type"] if isinstance(kind, dict) and isinstance(kind.get("type"), str) and kind["type"] in ("int", "long", "float", "double") else kind
        out: list = []
        while count := self.long():
            if count < 0:
                count = -count
                self.long()  # size in bytes
            if plain in ("int", "long"):
                out.append(self.longs(count))
            elif plain in ("float", "double"):
                width = 4 if plain == "float" else 8
                out.append(np.frombuffer(self.take(width * count), f"<f{width}"))
            else:
                out.extend(self.value(kind, names) for _ in range(count))
        if isinstance(plain, str) and plain in ("int", "long", "float", "double"):
            return np.concatenate(out) if out else np.zeros(0, np.int64 if plain in ("int", "long") else np.float64)
        return out

    def value(self, kind, names: dict):
        if isinstance(kind, list):
            return self.value(kind[self.long()], names)
        if isinstance(kind, str):
            match kind:
                case "null":
                    return None
                case "boolean":
                    return self.take(1) != b"\0"
                case "int" | "long":
                    return self.long()
                case "float":
                    return struct.unpack("<f", self.take(4))[0]
                case "double":
                    return struct.unpack("<d", self.take(8))[0]
                case "bytes":
                    return self.take(self.long())
                case "string":
                    return self.take(self.long()).decode()
            if kind not in names:
                raise ValueError(f"unknown type {kind}")
            return self.value(names[kind], names)
        match kind["type"]:
            case "record" | "error":
                return {f["name"]: self.value(f["type"], names) for f in kind["fields"]}
            case "enum":
                return kind["symbols"][self.long()]
            case "array":
                return self.items(kind["items"], names)
            case "map":
                out = {}
                while count := self.long():
                    if count < 0:
                        count = -count
                        self.long()
                    for _ in range(count):
                        key = self.value("string", names)
                        out[key] = self.value(kind["values"], names)
                return out
            case "fixed":
                return self.take(kind["size"])
        return self.value(kind["type"], names)


def _named(kind, names: dict, space: str = "") -> dict:
    """All named types within a schema, by full and, where that is free, by short name."""
    if isinstance(kind, list):
        for k in kind:
            _named(k, names, space)
    elif isinstance(kind, dict):
        if kind.get("type") in ("record", "error", "enum", "fixed"):
            space = kind.get("namespace", space)
            full = kind["name"] if "." in kind["name"] or not space else f"{space}.{kind['name']}"
            names[full] = kind
            names.setdefault(full.rsplit(".", 1)[-1], kind)
        for f in kind.get("fields", []):
            _named(f["type"], names, space)
        for part in ("items", "values", "type"):
            if isinstance(kind.get(part), (dict, list)):
                _named(kind[part], names, space)
    return names


def records(path: str):
    """The records of a container file, one at a time."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is no Avro container")
    head = Decoder(data)
    head.at = 4
    meta = head.value({"type": "map", "values": "bytes"}, {})
    sync, schema, codec = head.take(16), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in CODECS:
        raise ValueError(f"{path} is compressed by {codec}; known are {sorted(CODECS)}")
    names = _named(schema, {})
    while head.at < len(data):
        count, size = head.long(), head.long()
        block = Decoder(CODECS[codec](head.take(size)))
        for _ in range(count):
            yield block.value(schema, names)
        if head.take(16) != sync:
            raise ValueError(f"a block of {path} is damaged")


# -- wristband recordings ----------------------------------------------------

#: Streams of a recording by their name in the file.
STREAMS = {"accelerometer": "accel", "gyroscope": "gyro", "eda": "eda", "temperature": "temperature", "bvp": "bvp", "systolicPeaks": "systolic_peaks", "steps": "steps"}
SCHEMA = "recording_id string, stream string, sample_idx long, t double, fs double, x double, y double, z double"


def stream_columns(name: str, raw: dict, shift: float) -> dict[str, np.ndarray] | None:
    """t, fs and x, y, z (or x alone) of one stream, or None if it is empty.

    Converter counts become physical units; peaks have times only.
    """
    if name == "systolicPeaks":
        t = np.asarray(raw["peaksTimeNanos"]) / 1e9 + shift
        return {"t": t} if len(t) else None
    axes = "xyz" if "x" in raw else ("values",)
    values = [np.asarray(raw[a], float) for a in axes]
    if not len(values[0]):
        return None
    if "imuParams" in raw:
        p = raw["imuParams"]
        values = [physical(v, p["digitalMin"], p["digitalMax"], p["physicalMin"], p["physicalMax"]) for v in values]
    fs = raw["samplingFrequency"] if name == "accelerometer" else round(raw["samplingFrequency"], 3)
    t = raw["timestampStart"] / 1e6 + shift + np.arange(len(values[0])) / fs
    return {"t": t, "fs": np.full(len(t), fs)} | dict(zip("xyz", values, strict=False))


class EmpaticaSource(DataSource):
    """format("empatica"), options path (file, folder or pattern) and local (default true): rows of all streams.

    Times are of the local clock, by the file's own offset, or UTC with local
    false.  The first record of a file is read; empty streams give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "empatica"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _EmpaticaReader(self.options)


class _EmpaticaReader(DataSourceReader):
    ROWS = 1 << 16

    def __init__(self, options):
        self.path, self.local = options.get("path"), str(options.get("local", "true")).lower() == "true"

    def partitions(self):
        path = self.path or ""
        listed = sorted(glob.glob(os.path.join(path, "*.avro"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [self.path]
        return [Range(p, 0, 1) for p in listed if checked(p, (".avro",))]

    def read(self, partition):
        import pyarrow as pa

        first = next(records(partition.path), None)
        shift = float(first.get("timezone") or 0) if first and self.local else 0.0
        for name, stream in STREAMS.items() if first else ():
            got = stream_columns(name, first["rawData"][name], shift) if first["rawData"].get(name) else None
            if got is None:
                continue
            for lo in range(0, len(got["t"]), self.ROWS):
                n = len(got["t"][lo : lo + self.ROWS])
                numbers = [pa.array(got[c][lo : lo + n], pa.float64()) if c in got else pa.nulls(n, pa.float64()) for c in ("t", "fs", "x", "y", "z")]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([stream] * n), pa.array(np.arange(lo, lo + n)), *numbers], names=["recording_id", "stream", "sample_idx", "t", "fs", "x", "y", "z"])


def on_accelerometer(streams: DataFrame) -> DataFrame:
    """Samples (recording_id, sample_idx, t, ax, ay, az, and a column for each other stream present) at the accelerometer's times.

    Streams at its rate or a higher one are low-passed first; peaks and steps are left out.
    """
    rates = streams.filter("fs is not null").groupBy("stream").agg(F.min("fs").alias("fs"))
    known = {r.stream: r.fs for r in rates.collect()}  # seven streams at most
    own = streams.filter("stream = 'accel'").select(KEY, "sample_idx", "t", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    out, times = own, own.select(KEY, "sample_idx", "t")
    for stream, fs in sorted(known.items()):
        if stream in ("accel", "systolic_peaks", "steps") or "accel" not in known:
            continue
        names = {"x": "gx", "y": "gy", "z": "gz"} if stream == "gyro" else {"x": stream}
        part = streams.filter(F.col("stream") == stream).select(KEY, "sample_idx", "t", *[F.col(a).alias(b) for a, b in names.items()])
        factor = fs / known["accel"]
        if factor >= 1:
            part = low_passed(part, list(names.values()), 0.8 / factor if float(factor).is_integer() else 1 / factor)
        out = out.join(interpolated_at(part, list(names.values()), times).drop("t"), [KEY, "sample_idx"], "left")
    return out
