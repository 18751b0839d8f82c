import struct
import zlib

import numpy as np
import pytest

from kinelake import sources
from kinelake.sources import hdf5

NOWHERE = (1 << 64) - 1


def padded(b):
    return b + b"\0" * (-len(b) % 8)


def datatype(kind):
    kind = np.dtype(kind)
    if kind.kind == "S":
        return struct.pack("<B3sI", 0x13, b"\0\0\0", kind.itemsize)
    if kind.kind == "f":
        return struct.pack("<B3sI", 0x11, bytes([0x20, 63, 0]), kind.itemsize) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    return struct.pack("<B3sI", 0x10, bytes([8 if kind.kind == "i" else 0, 0, 0]), kind.itemsize) + struct.pack("<HH", 0, 8 * kind.itemsize)


def dataspace(shape):
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


class Writer:
    """Just enough of the format to write groups, datasets and attributes, in its first version."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, b):
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += b
        return at

    def header(self, *messages, split=False):
        """An object header; with split, all messages but the first lie in a continuation."""
        packed = [struct.pack("<HHB3x", kind, len(padded(b)), 0) + padded(b) for kind, b in messages]
        if split:
            rest = b"".join(packed[1:])
            at = self.put(rest)
            packed = [packed[0], struct.pack("<HHB3x", 0x10, 16, 0) + struct.pack("<QQ", at, len(rest))]
        body = b"".join(packed)
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + split, 1, len(body)) + body)

    def attribute(self, name, value):
        value, name = np.asarray(value), name.encode() + b"\0"
        kind, space = datatype(value.dtype), dataspace(value.shape)
        return 0x0C, struct.pack("<BxHHH", 1, len(name), len(kind), len(space)) + padded(name) + padded(kind) + padded(space) + value.tobytes()

    def dataset(self, value, chunk=None, filters=(), split=False):
        value = np.asarray(value)
        messages = [(0x01, dataspace(value.shape)), (0x03, datatype(value.dtype))]
        if chunk is None:
            at = self.put(value.tobytes())
            return self.header(*messages, (0x08, struct.pack("<BBQQ", 3, 1, at, value.nbytes)), split=split)
        entries = []
        for corner in np.ndindex(*(-(-n // c) for n, c in zip(value.shape, chunk))):
            begin = [i * c for i, c in zip(corner, chunk)]
            part = np.zeros(chunk, value.dtype)
            inside = value[tuple(slice(b, b + c) for b, c in zip(begin, chunk))]
            part[tuple(slice(0, n) for n in inside.shape)] = inside
            raw = part.tobytes()
            for f in filters:
                raw = {1: zlib.compress, 2: lambda r: np.frombuffer(r, np.uint8).reshape(-1, value.itemsize).T.tobytes(), 3: lambda r: r + b"\1\2\3\4"}[f](raw)
            entries.append((struct.pack("<II", len(raw), 0) + b"".join(struct.pack("<Q", b) for b in (*begin, 0)), self.put(raw)))
        leaf = lambda some, level=0: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in some) + some[-1][0])
        half = len(entries) // 2
        tree = leaf([(entries[0][0], leaf(entries[:half])), (entries[half][0], leaf(entries[half:]))], 1) if half else leaf(entries)
        layout = struct.pack("<BBBQ", 3, 2, len(chunk) + 1, tree) + b"".join(struct.pack("<I", n) for n in (*chunk, value.itemsize))
        piped = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", f, 0, 0, f == 2) + (struct.pack("<II", value.itemsize, 0) if f == 2 else b"") for f in filters)
        return self.header(*messages, (0x08, layout), *([(0x0B, piped)] if filters else []))

    def group(self, links, *attributes):
        names, offsets = bytearray(8), {}
        for name in sorted(links):
            offsets[name] = len(names)
            names += padded(name.encode() + b"\0")
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(bytes(names))))
        table = self.put(b"SNOD" + struct.pack("<BxH", 1, len(links)) + b"".join(struct.pack("<QQI4x16x", offsets[n], links[n], 0) for n in sorted(links)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, table, 0))
        return self.header((0x11, struct.pack("<QQ", tree, heap)), *attributes)

    def compact_group(self, links):
        """A group of the newer kind, its links in the header."""
        body = b""
        for name, at in links.items():
            link = struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", at)
            body += struct.pack("<BHB", 0x06, len(link), 0) + link
        return self.put(b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + b"\0\0\0\0")

    def bytes(self, root, version=0):
        if version == 0:
            head = hdf5.SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.data), NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
        else:
            head = hdf5.SIGNATURE + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQI", 0, NOWHERE, len(self.data), root, 0)
        self.data[: len(head)] = head
        return bytes(self.data)


def recording(path, n=1000, version=0, **how):
    rng, w = np.random.default_rng(0), Writer()
    accel, gyro = rng.normal(0, 9.81, (n, 3)), rng.normal(0, 1, (n, 3)).astype("f4")
    time = 1_700_000_000_000_000 + np.arange(n, dtype="u8") * 7812
    sensors = {}
    for name, label in (("100", "Sternum"), ("200", "Lumbar")):
        config = w.group({}, w.attribute("Label 0", np.bytes_(label)), w.attribute("Timezone Offset", np.float64(-5.0)))
        part = {"Accelerometer": accel if label == "Lumbar" else accel * 0, "Time": time, "Gyroscope": gyro, "Temperature": np.linspace(20, 30, n)}
        sensors[name] = w.group({"Configuration": config, **{k: w.dataset(v, **({"chunk": (128, *v.shape[1:]), **how} if how and k != "Time" else {})) for k, v in part.items()}})
    sensors["300"] = w.group({})  # a sensor without configuration
    group = w.group if version == 0 else w.compact_group
    path.write_bytes(w.bytes(group({"Sensors": group(sensors)}), version))
    return accel, gyro, time


@pytest.mark.parametrize("version, how", [(0, {}), (0, {"filters": (2, 1)}), (0, {"filters": (2, 1, 3)}), (2, {"filters": ()})])
def test_source(spark, tmp_path, version, how):
    path = tmp_path / "a.h5"
    accel, gyro, time = recording(path, version=version, **how)
    sources.register(spark)
    read = lambda **o: spark.read.format("apdm").options(path=str(path), **o).load().orderBy("sample_idx").toPandas()
    got = read(sensor="Lumbar")
    assert np.allclose(got[["ax", "ay", "az"]], accel / 9.81) and np.allclose(got[["gx", "gy", "gz"]], gyro) and np.allclose(got.temperature, np.linspace(20, 30, 1000))
    assert np.allclose(got.t, time / 1e6 - 5 * 3600) and got.sample_idx.tolist() == list(range(1000))
    if not how:
        assert np.allclose(read(sensor="Lumbar", local="false", offset_hours="-5").t, time / 1e6) and not read(sensor="Sternum").ax.any()
        with pytest.raises(Exception, match="h from UTC"):
            read(sensor="Lumbar", offset_hours="1")
        with pytest.raises(Exception, match="Left Foot"):
            read(sensor="Left Foot")
        with pytest.raises(Exception, match="option sensor"):
            read()


def test_objects():
    w = Writer()
    numbers, words = np.arange(-5, 7, dtype=">i2".replace(">", "<")).reshape(3, 4), np.array([b"one", b"three"])
    many = np.arange(1000, dtype="u4").reshape(20, 50)
    inner = w.group({"numbers": w.dataset(numbers, split=True), "words": w.dataset(words)}, w.attribute("rate", np.array([1.5, 2.5])))
    data = w.bytes(w.group({"inner": inner, "many": w.dataset(many, chunk=(7, 16), filters=(2, 1))}))
    for shift in (0, 512):  # a file may begin with a block of its user
        f = hdf5.File(bytes(shift) + data)
        assert sorted(f.root.links()) == ["inner", "many"] and f.root["inner"].attributes()["rate"].tolist() == [1.5, 2.5]
        assert (f.root["inner/numbers"].read() == numbers).all() and f.root["inner"]["words"].read().tolist() == [b"one", b"three"] and (f.root["many"].read() == many).all()
    with pytest.raises(KeyError):
        f.root["inner/none"]
    with pytest.raises(ValueError):
        hdf5.File(b"nothing" * 200)
    with pytest.raises(NotImplementedError):
        hdf5._unfiltered(32000, [], b"")
