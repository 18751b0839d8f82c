"""Binary recordings as Python data sources: one partition a file, or a range of its blocks.

Bytes are fetched through Spark's binary reader on the driver only for sizes and
headers; executors open their own range, so paths must be visible to them.
"""

from __future__ import annotations

import calendar
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Smallest file that can hold a recording.
LEAST_BYTES = 1000


class FileSizeError(ValueError):
    """The file is too small to hold a recording."""


def checked(path: str | None, suffixes: tuple[str, ...], on_suffix: str = "warn", skip_small: bool = False) -> bool:
    """Whether to read: raises for missing and small files, warns of or raises for other suffixes."""
    import warnings

    if path is None:
        raise ValueError("a file is needed")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(suffixes):
        if on_suffix == "raise":
            raise ValueError(f"{path} does not end in {' or '.join(suffixes)}")
        if on_suffix == "skip":
            return False
        warnings.warn(f"{path} does not end in {' or '.join(suffixes)}", UserWarning, stacklevel=2)
    if os.path.getsize(path) < LEAST_BYTES:
        if skip_small:
            return False
        raise FileSizeError(f"{path} has under {LEAST_BYTES} bytes")
    return True


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


def _ranges(path: str, total: int, size: int) -> list[Range]:
    return [Range(path, lo, min(total, lo + size)) for lo in range(0, total, size)]


# -- 512-byte blocks of packed samples --------------------------------------

BLOCK, RATE_BASE = 512, 3200


def packed_time(value: int, fraction: int) -> float:
    """Seconds since 1970 of a packed clock (6 bits year ... 6 bits second) and a fraction of a second by 65536."""
    year, month, day = 2000 + (value >> 26 & 63), value >> 22 & 15, value >> 17 & 31
    clock = (year, month, day, value >> 12 & 31, value >> 6 & 63, value & 63)
    return calendar.timegm((*clock, 0, 0, 0)) + fraction / 65536


def three_axes(words: np.ndarray) -> np.ndarray:
    """Three signed 10-bit numbers and a common exponent from each 32-bit word."""
    parts = np.stack([words >> shift & 0x3FF for shift in (0, 10, 20)], axis=1).astype(np.int32)
    parts = np.where(parts >= 512, parts - 1024, parts)
    return parts << (words >> 30).astype(np.int32)[:, None]


def decode_block(block: bytes) -> dict | None:
    """Samples of one block, or None if it is not a data block or its checksum fails."""
    if block[:2] != b"AX" or int(np.frombuffer(block, "<u2").sum(dtype=np.uint64)) & 0xFFFF:
        return None
    fraction, session, sequence, stamp, light, temperature, _, battery, rate, layout, offset, count = struct.unpack_from("<HIIIHHBBBBhH", block, 4)
    axes, kind = layout >> 4, layout & 15
    fs = RATE_BASE / (1 << (15 - (rate & 15)))
    if kind == 0 and axes == 3:
        data = three_axes(np.frombuffer(block, "<u4", count, 30))
    else:
        data = np.frombuffer(block, "<i2", count * axes, 30).reshape(count, axes).astype(np.int32)
    unit = 1 << (8 + (light >> 13))
    out = {"sequence": sequence, "fs": fs, "n": count, "temperature": ((temperature & 0x3FF) - 171) / 3.142}
    accel = data[:, 3:6] if axes >= 6 else data[:, :3]
    out["accel"] = accel / unit
    if axes >= 6:
        out["gyro"] = data[:, :3] * ((8000 / (1 << (light >> 10 & 7))) / 32768)
    fractional = fraction & 0x7FFF if fraction & 0x8000 else 0
    shift = offset + ((fractional * int(fs)) >> 16 if fraction & 0x8000 else 0)
    out["t"] = packed_time(stamp, (fractional << 1) & 0xFFFF if fraction & 0x8000 else 0) - shift / fs
    return out


class AxivitySource(DataSource):
    """format("cwa"), option path: sequence, sample_idx, t, ax, ay, az, gx, gy, gz, temperature.

    Blocks are read independently; one that fails its checksum gives no rows,
    and gap filling closes what it leaves.
    """

    @classmethod
    def name(cls) -> str:
        return "cwa"

    def schema(self) -> str:
        return "recording_id string, sample_idx long, t double, ax double, ay double, az double, gx double, gy double, gz double, temperature double"

    def reader(self, schema):
        return _AxivityReader(self.options)


class _AxivityReader(DataSourceReader):
    HEADER, BLOCKS = 1024, 20_000

    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        checked(self.path, (".cwa",))
        return _ranges(self.path, (os.path.getsize(self.path) - self.HEADER) // BLOCK, self.BLOCKS)

    def read(self, partition):
        with open(partition.path, "rb") as f:
            if f.read(2) != b"MD":
                raise ValueError(f"{partition.path} has no metadata block")
            f.seek(self.HEADER + partition.first * BLOCK)
            for _ in range(partition.first, partition.last):
                got = decode_block(f.read(BLOCK))
                if got is None:
                    continue
                base = got["sequence"] * got["n"]
                for i, a in enumerate(got["accel"]):
                    g = got["gyro"][i].tolist() if "gyro" in got else (None, None, None)
                    yield (partition.path, base + i, got["t"] + i / got["fs"], *map(float, a), *g, got["temperature"])


# -- text pages of hexadecimal samples --------------------------------------

PAGE = 300


def decode_page(hexadecimal: str, gain, offset, volts: float, lux: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerations in g and light of one page: 12 hexadecimal digits a sample, three signed 12-bit axes and 12 bits of light."""
    raw = np.array([int(hexadecimal[i : i + 12], 16) for i in range(0, len(hexadecimal) // 12 * 12, 12)], np.uint64)
    axes = np.stack([(raw >> np.uint64(s) & np.uint64(0xFFF)).astype(np.int64) for s in (36, 24, 12)], axis=1)
    axes = np.where(axes >= 2048, axes - 4096, axes)
    light = (raw & np.uint64(0xFFF)).astype(np.int64) >> 2
    return (axes * 100.0 - np.asarray(offset)) / np.asarray(gain), np.floor(light * lux / volts)


class GeneActivSource(DataSource):
    """format("geneactiv"), option path: samples with light and the page's temperature."""

    @classmethod
    def name(cls) -> str:
        return "geneactiv"

    def schema(self) -> str:
        return "recording_id string, sample_idx long, t double, ax double, ay double, az double, light double, temperature double"

    def reader(self, schema):
        return _GeneActivReader(self.options)


class _GeneActivReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        checked(self.path, (".bin",))
        return [Range(self.path, 0, 1)]

    def read(self, partition):
        from datetime import datetime, timezone

        header: dict[str, str] = {}
        page: dict[str, str] = {}
        number = lambda text: float("".join(c for c in text.split()[0] if c in "+-.0123456789"))
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            in_page = False
            for line in f:
                line = line.rstrip("\r\n")
                if line == "Recorded Data":
                    in_page, page = True, {}
                    continue
                name, _, value = line.partition(":")
                if not in_page:
                    header.setdefault(name.strip(), value.strip())
                    continue
                if value or not _hexadecimal(line):
                    page[name.strip()] = value.strip()
                    continue
                gain, offset = [number(header[f"{a} gain"]) for a in "xyz"], [number(header[f"{a} offset"]) for a in "xyz"]
                accel, light = decode_page(line, gain, offset, number(header["Volts"]), number(header["Lux"]))
                fs = number(page.get("Measurement Frequency", header.get("Measurement Frequency", "0")))
                stamp = datetime.strptime(page["Page Time"], "%Y-%m-%d %H:%M:%S:%f").replace(tzinfo=timezone.utc).timestamp()
                base = int(number(page["Sequence Number"])) * PAGE
                for i in range(len(accel)):
                    yield (partition.path, base + i, stamp + i / fs, *map(float, accel[i]), float(light[i]), number(page["Temperature"]))


def _hexadecimal(line: str) -> bool:
    return len(line) >= 12 and all(c in "0123456789abcdefABCDEF" for c in line)


# -- arrays -----------------------------------------------------------------


class NumpySource(DataSource):
    """format("npz"), option path: samples of an archive with time and accel (and gyro, temperature)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "recording_id string, sample_idx long, t double, ax double, ay double, az double, gx double, gy double, gz double, temperature double"

    def reader(self, schema):
        return _NumpyReader(self.options)


class _NumpyReader(DataSourceReader):
    ROWS = 1_000_000

    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        checked(self.path, (".npz",))
        with np.load(self.path, allow_pickle=False) as data:
            if not {"time", "accel"} <= set(data.files):
                raise ValueError(f"{self.path} lacks time or accel")
            return _ranges(self.path, len(data["time"]), self.ROWS)

    def read(self, partition):
        part = slice(partition.first, partition.last)
        with np.load(partition.path, allow_pickle=False) as data:
            t, a = data["time"][part], data["accel"][part]
            g = data["gyro"][part] if "gyro" in data.files else None
            temp = data["temperature"][part] if "temperature" in data.files else None
        for i in range(len(t)):
            yield (partition.path, partition.first + i, float(t[i]), *map(float, a[i]), *(map(float, g[i]) if g is not None else (None,) * 3), float(temp[i]) if temp is not None else None)
