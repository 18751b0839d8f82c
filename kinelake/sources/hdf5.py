"""HDF5 files in Python, as far as sensor recordings need them, and such recordings as a data source.

Read are groups (symbol tables and compact links), numeric datasets and strings,
stored compact, contiguous or in chunks under a version 1 tree, with deflate,
shuffle and checksums; and attributes of objects.  What is stored otherwise
(dense links, newer chunk indexes) raises NotImplementedError with its name.
"""

from __future__ import annotations

import glob
import math
import os
import struct
import zlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader

from kinelake.sources.binary import Range, checked

SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11


def _padded(n: int) -> int:
    return n + -n % 8


class File:
    """The objects of a file, from its root."""

    def __init__(self, data: bytes):
        self.data = data
        starts = [0, *(512 << k for k in range(max(0, len(data).bit_length() - 9)))]
        self.base = next((s for s in starts if data[s : s + 8] == SIGNATURE), None)
        if self.base is None:
            raise ValueError("no HDF5 file")
        version = data[self.base + 8]
        if version < 2:
            self.offset_size, self.length_size = data[self.base + 13], data[self.base + 14]
            entry = self.base + (24 if version == 0 else 28) + 4 * self.offset_size
            self.root = Object(self, self.offset(entry + self.offset_size))
        else:
            self.offset_size, self.length_size = data[self.base + 9], data[self.base + 10]
            self.root = Object(self, self.offset(self.base + 12 + 3 * self.offset_size))

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], "little")

    def offset(self, at: int) -> int | None:
        value = self.number(at, self.offset_size)
        return None if value == (1 << 8 * self.offset_size) - 1 else value + self.base

    def length(self, at: int) -> int:
        return self.number(at, self.length_size)

    def expect(self, at: int, signature: bytes) -> None:
        if self.data[at : at + 4] != signature:
            raise ValueError(f"{signature.decode()} is missing at byte {at}")

    def messages(self, at: int) -> list[tuple[int, int, int]]:
        """Kind, place and size of all messages of an object's header."""
        if self.data[at : at + 4] == b"OHDR":
            flags, place = self.data[at + 5], at + 6
            place += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks, extra, newer = [(place + width, self.number(place, width))], (2 if flags & 4 else 0), True
        else:
            blocks, extra, newer = [(at + 16, self.number(at + 8, 4))], 0, False
        out = []
        while blocks:
            place, size = blocks.pop(0)
            end = place + size
            head = 4 + extra if newer else 8
            while place + head <= end:
                kind, n = (self.data[place], self.number(place + 1, 2)) if newer else (self.number(place, 2), self.number(place + 2, 2))
                if kind == CONTINUED:
                    more, length = self.offset(place + head), self.length(place + head + self.offset_size)
                    blocks.append((more + 4, length - 8) if newer else (more, length))  # newer blocks have a signature and a checksum
                out.append((kind, place + head, n))
                place += head + n
        return out

    def links_of_table(self, tree: int, heap: int) -> dict[str, int]:
        self.expect(heap, b"HEAP")
        names = self.offset(heap + 8 + 2 * self.length_size)
        out = {}
        for node in self.leaves(tree, 0, self.length_size):
            self.expect(node[1], b"SNOD")
            for i in range(self.number(node[1] + 6, 2)):
                entry = node[1] + 8 + i * (2 * self.offset_size + 24)
                at = names + self.number(entry, self.offset_size)
                out[self.data[at : self.data.index(b"\0", at)].decode()] = self.offset(entry + self.offset_size)
        return out

    def leaves(self, node: int | None, kind: int, key_size: int):
        """Place of the key, and child, of all entries at the bottom of a version 1 tree."""
        if node is None:
            return
        self.expect(node, b"TREE")
        if self.data[node + 4] != kind:
            raise ValueError(f"the tree at byte {node} is of another kind")
        level, count, at = self.data[node + 5], self.number(node + 6, 2), node + 8 + 2 * self.offset_size
        for i in range(count):
            key = at + i * (key_size + self.offset_size)
            child = self.offset(key + key_size)
            if level:
                yield from self.leaves(child, kind, key_size)
            else:
                yield key, child

    def shape(self, at: int) -> tuple[int, ...]:
        version, rank = self.data[at], self.data[at + 1]
        first = at + (8 if version == 1 else 4)
        return tuple(self.length(first + k * self.length_size) for k in range(rank))

    def kind(self, at: int) -> tuple[str, np.dtype]:
        """What a datatype holds, number, string or reference to a string, and how it is stored."""
        cls, bits, size = self.data[at] & 15, self.data[at + 1], self.number(at + 4, 4)
        order = ">" if bits & 1 else "<"
        if cls == 0:
            return "number", np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        if cls == 1:
            return "number", np.dtype(f"{order}f{size}")
        if cls == 3:
            return "string", np.dtype(f"S{size}")
        if cls == 9 and bits & 15 == 1:
            return "reference", np.dtype([("n", "<u4"), ("at", f"<u{self.offset_size}"), ("i", "<u4")])
        raise NotImplementedError(f"datatype class {cls}")

    def value(self, kind: tuple[str, np.dtype], raw: bytes, shape: tuple[int, ...]):
        flat = np.frombuffer(raw, kind[1], math.prod(shape))
        if kind[0] == "reference":
            flat = np.array([self.heap_object(int(r["at"]) + self.base, int(r["i"]))[: int(r["n"])] for r in flat], object)
        return flat.reshape(shape) if shape else flat[0]

    def heap_object(self, at: int, index: int) -> bytes:
        self.expect(at, b"GCOL")
        end, place = at + self.length(at + 8), at + 8 + self.length_size
        while place < end:
            found, size = self.number(place, 2), self.length(place + 8)
            if found == index:
                return self.data[place + 8 + self.length_size :][:size]
            if not found:
                break
            place += 8 + self.length_size + _padded(size)
        raise ValueError(f"object {index} is missing in the heap at byte {at}")


class Object:
    """A group or dataset with its attributes."""

    def __init__(self, file: File, at: int):
        self.file, self.found = file, file.messages(at)

    def _message(self, kind: int) -> int | None:
        return next((at for k, at, _ in self.found if k == kind), None)

    def links(self) -> dict[str, int]:
        f, table = self.file, self._message(SYMBOLS)
        if table is not None:
            return f.links_of_table(f.offset(table), f.offset(table + f.offset_size))
        info = self._message(LINK_INFO)
        if info is not None and f.offset(info + 2 + (8 if f.data[info + 1] & 1 else 0)) is not None:
            raise NotImplementedError("links in a fractal heap")
        out = {}
        for kind, at, _ in self.found:
            if kind != LINK:
                continue
            flags, place = f.data[at + 1], at + 2
            soft = flags & 8 and f.data[place] != 0
            place += sum(n for bit, n in ((8, 1), (4, 8), (16, 1)) if flags & bit)
            width = 1 << (flags & 3)
            n = f.number(place, width)
            if not soft:
                out[f.data[place + width : place + width + n].decode()] = f.offset(place + width + n)
        return out

    def __getitem__(self, path: str) -> Object:
        here = self
        for name in filter(None, path.split("/")):
            links = here.links()
            if name not in links:
                raise KeyError(f"{name} is not among {sorted(links)}")
            here = Object(self.file, links[name])
        return here

    def attributes(self) -> dict[str, object]:
        f, out = self.file, {}
        for message, at, _ in self.found:
            if message != ATTRIBUTE:
                continue
            version, sizes = f.data[at], [f.number(at + 2 + 2 * k, 2) for k in range(3)]
            place, parts = at + (9 if version == 3 else 8), []
            for n in sizes:
                parts.append(place)
                place += _padded(n) if version == 1 else n
            kind, shape = f.kind(parts[1]), f.shape(parts[2])
            raw = f.data[place : place + math.prod(shape) * kind[1].itemsize]
            out[f.data[parts[0] : parts[0] + sizes[0]].rstrip(b"\0").decode()] = f.value(kind, raw, shape)
        return out

    def _filters(self) -> list[tuple[int, list[int]]]:
        f, at = self.file, self._message(FILTERS)
        if at is None:
            return []
        version, count, place, out = f.data[at], f.data[at + 1], at + (8 if f.data[at] == 1 else 2), []
        for _ in range(count):
            number = f.number(place, 2)
            named = version == 1 or number >= 256
            name = f.number(place + 2, 2) if named else 0
            place += 4 if named else 2
            values = f.number(place + 2, 2)
            place += 4 + (_padded(name) if version == 1 else name)
            out.append((number, [f.number(place + 4 * k, 4) for k in range(values)]))
            place += 4 * (values + (values & 1 if version == 1 else 0))
        return out

    def read(self):
        """A dataset's values."""
        f, kind, shape = self.file, self.file.kind(self._message(DATATYPE)), self.file.shape(self._message(DATASPACE))
        at, size = self._message(LAYOUT), math.prod(shape) * kind[1].itemsize
        if f.data[at] != 3 and not (f.data[at] == 4 and f.data[at + 1] < 2):
            raise NotImplementedError(f"data layout version {f.data[at]}")
        match f.data[at + 1]:
            case 0:
                return f.value(kind, f.data[at + 4 : at + 4 + size], shape)
            case 1:
                begin = f.offset(at + 2)
                return f.value(kind, bytes(size) if begin is None else f.data[begin : begin + size], shape)
        rank = f.data[at + 2] - 1
        chunk = tuple(f.number(at + 3 + f.offset_size + 4 * k, 4) for k in range(rank))
        whole, filters = np.zeros(shape, kind[1]), self._filters()
        for key, child in f.leaves(f.offset(at + 3), 1, 8 + 8 * (rank + 1)):
            raw = f.data[child : child + f.number(key, 4)]
            for i, (number, values) in reversed(list(enumerate(filters))):
                if not f.number(key + 4, 4) >> i & 1:  # a bit for each filter that was left out
                    raw = _unfiltered(number, values, raw)
            corner = [f.number(key + 8 + 8 * k, 8) for k in range(rank)]
            part = tuple(slice(c, min(c + n, s)) for c, n, s in zip(corner, chunk, shape, strict=True))
            whole[part] = np.frombuffer(raw, kind[1], math.prod(chunk)).reshape(chunk)[tuple(slice(0, p.stop - p.start) for p in part)]
        return f.value(kind, whole.tobytes(), shape)


def _unfiltered(number: int, values: list[int], raw: bytes) -> bytes:
    match number:
        case 1:
            return zlib.decompress(raw)
        case 2:
            width, n = values[0], len(raw) // values[0]
            return np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes() + raw[n * width :]
        case 3:
            return raw[:-4]
    raise NotImplementedError(f"filter {number}")


# -- recordings of several sensors -------------------------------------------

GRAVITY = 9.81


class SensorNotFoundError(KeyError):
    """No sensor of the file has the wanted label."""


def _text(value) -> str:
    value = value.item() if isinstance(value, np.ndarray) and value.size == 1 else value
    return value.decode().rstrip("\0") if isinstance(value, bytes) else str(value)


def sensor(file: File, label: str) -> Object:
    """The sensor whose configuration has this label; sensors without one are passed over."""
    sensors = file.root["Sensors"]
    for name in sensors.links():
        try:
            found = sensors[name]["Configuration"].attributes().get("Label 0")
        except (KeyError, ValueError):
            continue
        if found is not None and _text(found) == label:
            return sensors[name]
    raise SensorNotFoundError(f"no sensor is labelled {label}")


class ApdmSource(DataSource):
    """format("apdm"), options path (file, folder or pattern), sensor (its label), local (default true) and gravity: samples.

    Accelerations are in g.  Times are of the local clock, by the sensor's own
    offset, or UTC with local false; an option offset_hours raises an error where
    the file says otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "apdm"

    def schema(self) -> str:
        return "recording_id string, sample_idx long, t double, ax double, ay double, az double, gx double, gy double, gz double, temperature double"

    def reader(self, schema):
        return _ApdmReader(self.options)


class _ApdmReader(DataSourceReader):
    ROWS = 1 << 16

    def __init__(self, options):
        self.path, self.label = options.get("path"), options.get("sensor")
        self.local, self.gravity = str(options.get("local", "true")).lower() == "true", float(options.get("gravity", GRAVITY))
        self.offset_hours = float(options["offset_hours"]) if "offset_hours" in options else None
        if self.label is None:
            raise ValueError("the option sensor names which one to read")

    def partitions(self):
        path = self.path or ""
        listed = sorted(glob.glob(os.path.join(path, "*.h5"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [self.path]
        return [Range(p, 0, 1) for p in listed if checked(p, (".h5",))]

    def read(self, partition):
        import pyarrow as pa

        with open(partition.path, "rb") as f:
            found = sensor(File(f.read()), self.label)
        hours = float(_text(found["Configuration"].attributes().get("Timezone Offset", 0.0)))
        if self.offset_hours is not None and not math.isclose(hours, self.offset_hours):
            raise ValueError(f"{partition.path} is {hours} h from UTC, not {self.offset_hours}")
        t = found["Time"].read().astype(float) / 1e6 + (3600 * hours if self.local else 0.0)
        accel, links = found["Accelerometer"].read().astype(float) / self.gravity, found.links()
        gyro = found["Gyroscope"].read().astype(float) if "Gyroscope" in links else None
        temperature = found["Temperature"].read().astype(float).ravel() if "Temperature" in links else None
        names = ["recording_id", "sample_idx", "t", "ax", "ay", "az", "gx", "gy", "gz", "temperature"]
        for lo in range(0, len(t), self.ROWS):
            hi = min(lo + self.ROWS, len(t))
            columns = [t, *accel.T, *(gyro.T if gyro is not None else (None,) * 3), temperature]
            numbers = [pa.array(np.ascontiguousarray(c[lo:hi]), pa.float64()) if c is not None else pa.nulls(hi - lo, pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (hi - lo)), pa.array(np.arange(lo, hi)), *numbers], names=names)
