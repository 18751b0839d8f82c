"""What the corpus operators share: reading, grouping and packing documents.

Three of the operators (repeated spans, language model, byte-level BPE) use one
exchange pattern.  Documents are dealt by a hash of their identifier into
groups of a few megabytes.  A group sends one compact block to each bucket of
a key space (keys, words), a bucket answers every block it received with one
block in the same order, and the group, recomputed from the same documents,
reads the answers.  Blocks are aggregated within the group before they are
sent, so a key that is everywhere costs one entry a group, and both sides hold
a bounded share of the input however large it is.
"""

from __future__ import annotations

import contextlib
import ctypes
import glob
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves all other letters alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Orders after every identifier; stands for a null identifier in comparisons.
NO_ID = np.iinfo(np.int64).max


def return_memory() -> None:
    """Lets freed arrays go back to the system at once.

    Workers live on between stages; without this each keeps the most it ever
    held.  The C library then maps every block over 4 MB on its own.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    _keep(4 << 20, 8 << 20)


def _keep(mapped: int, spare: int) -> None:
    """Sizes from which blocks are mapped on their own, and of free memory that the heap keeps."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, mapped)
        libc.mallopt(-1, spare)
    except (OSError, AttributeError):
        pass  # another C library keeps its own ways


def tidied(f):
    """f, a function of batches or of a group, after which the worker returns what it freed to the system.

    Workers wait for later stages with what lies between their live objects.
    """

    def release():
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def mapped(batches):
        yield from f(batches)
        release()

    def grouped(key, data):
        out = f(key, data)
        release()
        return out

    def cogrouped(key, left, right):
        out = f(key, left, right)
        release()
        return out

    return (mapped, grouped, cogrouped)[f.__code__.co_argcount - 1]


@contextlib.contextmanager
def reused_memory():
    """For loops over arrays of a few megabytes: the heap keeps them from one turn to the next."""
    _keep(32 << 20, 64 << 20)
    try:
        yield
    finally:
        _keep(4 << 20, 8 << 20)


def on_one_thread() -> None:
    """Matrix products run on the calling thread: a task has one core, and idle threads of a pool spin on others."""
    folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
    for path in glob.glob(os.path.join(folder, "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(path), name)(1)
                break
            except (OSError, AttributeError):
                continue  # another build keeps its own threads


return_memory()
on_one_thread()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch; texts are long, and several batches are in memory on both sides.  Operators that need no
#: larger block take BRIEF ones.
BATCH_BYTES, BRIEF = 8 << 20, 2 << 20


def in_small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """df; its session sends Python batches of that many bytes at most from now on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(name, f"{most}b")
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder in spark.checkpoint.dir and read back.

    A folder of our own is used only where the setting is absent (tests on one
    machine).
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def folded(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one pass over that column alone."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def group_count(total_bytes: int, group_mb: float) -> int:
    return max(1, math.ceil(total_bytes / (group_mb * 1e6)))


def in_groups(docs: DataFrame, groups: int) -> DataFrame:
    """Columns g, doc_id, text (null: empty) dealt by doc_id into `groups` groups."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    rows = in_small_batches(docs).select(key.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(max(groups, 1), "g")


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Identifiers as int64; null becomes NO_ID."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def packed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def binaries(sizes: np.ndarray, body: np.ndarray) -> pa.LargeBinaryArray:
    """Values of these sizes, cut one after the other from body."""
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def pieces(offsets: np.ndarray, most: int):
    """Ranges of rows of at most `most` bytes each, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def gathered(values: np.ndarray, begins: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[begins[p]:begins[p + 1]] for all picks one after the other, and their sizes."""
    first = begins[picks]
    sizes = begins[picks + 1] - first
    at = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return values[at], sizes


def squeeze(*arrays) -> bytes:
    """Arrays as one compressed blob, integers split into byte planes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        z = zstandard.compress(planes, 3)
        parts += [np.array([len(a), a.itemsize, len(z)], "<u4").tobytes(), z]
    return b"".join(parts)


def expand(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    while at < len(blob):
        n, width, z = (int(x) for x in np.frombuffer(blob, "<u4", 3, at))
        raw = np.frombuffer(zstandard.decompress(blob[at + 12 : at + 12 + z], max_output_size=max(1, n * width)), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).view(kinds[width]).ravel() if n else np.zeros(0, kinds[width]))
        at += 12 + z
    return out
