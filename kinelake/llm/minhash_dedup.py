"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of distinct five-word shingles.  The sketch places
elements into `T` bins over rounds: in the first T rounds every element goes to
a hashed bin, in the last T every element goes to the round's own bin, and a
bin keeps the smallest value of the first round that reached it.  So every
coordinate fills, a set of n elements needs about T log T / n rounds, and the
share of equal coordinates concentrates around the Jaccard similarity.

1. Documents with equal sets are one vertex, the smallest identifier.
2. Sketches are cut into bands; vertices that agree in a band share a bucket.
   At similarity 0.85 a pair shares none of 24 bands of 5 with probability 1e-6.
3. Star: in each bucket the vertex with the most bucket mates is compared with
   every other, on full sets.  A bucket of m vertices costs m - 1 comparisons.
4. Rest: links joined so far make components.  Where a bucket still holds
   several, its members travel with their full sets, dealt into blocks of
   bounded size; those outside the bucket's largest component go to all its
   blocks.  A block counts the common shingles of such a member with all others
   at once, from lists of who holds each shingle, and returns only links that
   join components, so neither pairs nor links of a large group multiply.
5. Components of all links, smallest identifier first.

Defined results: null text and texts without words have an empty set and are
linked with nothing.  Rows with one identifier are one document: linked.  Rows
without identifier take part, those of equal texts as one document; a component
of such rows only has component_id null, and one of its documents is kept.  An
empty table gives an empty result.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import BRIEF, NO_ID, checkpointed, gathered, ids, in_small_batches, packed, pieces, table, tidied
from kinelake.llm.components import connected_components
from kinelake.llm.textkernels import mix, shingle_sets

WORDS, BANDS, DEPTH = 5, 24, 5
T = BANDS * DEPTH
#: Shingles in a block of a large bucket, about.
BLOCK_ITEMS = 1 << 20
#: Identifiers that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes of text in one vectorised step.
STEP = 1 << 20
#: Names of rows without identifier lie above this.
NAMELESS = 1 << 62

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8864B)


def sketches(values: np.ndarray, offsets: np.ndarray, t: int = T) -> np.ndarray:
    """Sketch of each set values[offsets[i]:offsets[i + 1]], one row of t 32-bit coordinates (0 for empty sets)."""
    n = len(offsets) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    size = np.diff(offsets)
    live = np.flatnonzero(size)
    row = np.repeat(np.arange(n), size)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(values ^ np.uint64(int(_C1) * (i + 1) & (1 << 64) - 1))
        bin_of = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        # the round first, then 56 bits of a value: a later round never displaces an earlier one
        value = (np.uint64(i) << np.uint64(56)) | (mix(h ^ _C2) >> np.uint64(8))
        np.minimum.at(out, row * t + bin_of, value)
        full = (out.reshape(n, t)[live] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            live = live[~full]
            stay = np.zeros(n, bool)
            stay[live] = True
            keep = stay[row]
            values, row = values[keep], row[keep]
    out = (mix(out) >> np.uint64(32)).astype(np.uint32).reshape(n, t)
    out[size == 0] = 0
    return out


def band_hashes(sketch: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """One 64-bit hash for each row and band."""
    part = sketch.reshape(len(sketch), bands, depth).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _C2 + np.zeros((len(sketch), 1), np.uint64)
    for k in range(depth):
        h = mix(h * _C1 + part[:, :, k])
    return h.view(np.int64)


def _steps(batches):
    """Names, bytes of texts and their offsets.  A row's name is its identifier, or lies above NAMELESS and comes from its text."""
    for batch in batches:
        doc, digest = ids(batch.column("doc_id")), batch.column("digest").to_numpy(zero_copy_only=False)
        name = np.where(doc == NO_ID, NAMELESS + (digest.astype(np.int64).view(np.uint64) >> np.uint64(2)).astype(np.int64), doc)
        body, offsets = packed(batch.column("text"))
        for lo, hi in pieces(offsets, STEP):
            yield doc[lo:hi], name[lo:hi], body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest"))


def _digest() -> Column:
    """Tells texts of rows without identifier apart; 0 with one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))


def _set_ids(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = values.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


FEATURES = "doc_id long, v long, n long, set_id binary, bands array<long>"
SETS = "v long, n long, items binary"


def features(docs: DataFrame, words: int = WORDS, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """Of each row: its name v, size n of its set, digest of the set and band hashes of its sketch."""

    def run(batches):
        for doc, name, body, offsets in _steps(batches):
            values, at = shingle_sets(body, offsets, words)
            set_ids = _set_ids(values, at)
            hashes = band_hashes(sketches(values, at, bands * depth), bands, depth)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1) * bands, pa.int32()), pa.array(hashes.ravel()))
            yield pa.record_batch({"doc_id": pa.array(doc, mask=doc == NO_ID), "v": pa.array(name), "n": pa.array(np.diff(at)), "set_id": pa.array(set_ids, pa.binary()), "bands": lists})

    return _named(in_small_batches(docs, BRIEF)).mapInArrow(tidied(run), FEATURES)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Full sets (64-bit hashes, ascending) of the vertices in wanted (v)."""
    texts = _named(docs).withColumn("u", F.coalesce("doc_id", F.lit(NO_ID)))
    asked = wanted.select(F.when(F.col("v") >= NAMELESS, F.lit(NO_ID)).otherwise(F.col("v")).alias("u")).distinct()
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)

    def run(batches):
        for _, name, body, offsets in _steps(batches):
            values, at = shingle_sets(body, offsets, words)
            raw = values.tobytes()
            yield pa.record_batch({"v": pa.array(name), "n": pa.array(np.diff(at)), "items": pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return texts.join(asked, "u", "left_semi").select("doc_id", "text", "digest").mapInArrow(tidied(run), SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 x intersection >= percent x union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})

    items = sets.select("v", "items")
    full = pairs.join(items.withColumnsRenamed({"v": "a", "items": "x"}), "a").join(items.withColumnsRenamed({"v": "b", "items": "y"}), "b")
    return full.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _joining(percent: int):
    """Links of one block that join components: full sets of its members, and those outside the largest component."""

    def run(key, data):
        data = data.sort_by("v")
        v, n, label, own = (data[c].to_numpy() for c in ("v", "n", "label", "own"))
        items, offsets = packed(data["items"])
        items, offsets = items.view(np.uint64), offsets // 8
        holder = np.repeat(np.arange(len(v)), np.diff(offsets))
        by = np.argsort(items, kind="stable")
        holder, heads = holder[by], np.flatnonzero(np.concatenate([[True], items[by][1:] != items[by][:-1]]))
        begins = np.append(heads, len(by))
        number = np.empty(len(by), np.int64)
        number[by] = np.repeat(np.arange(len(heads)), np.diff(begins))
        names, component = np.unique(label, return_inverse=True)
        parent = np.arange(len(names))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for i in np.flatnonzero(data["outside"].to_numpy()).tolist():
            met, _ = gathered(holder, begins, number[offsets[i] : offsets[i + 1]])
            common = np.bincount(met, minlength=len(v))
            linked = np.flatnonzero(own & (label != label[i]) & (common > 0) & (100 * common >= percent * (n + n[i] - common)))
            for j in linked[np.unique(component[linked], return_index=True)[1]].tolist():
                x, y = root(component[i]), root(component[j])
                if x != y:
                    parent[x] = y
                    a.append(min(v[i], v[j]))
                    b.append(max(v[i], v[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _components(docs: DataFrame, percent: int, words: int, bands: int, depth: int) -> DataFrame:
    """One row a document: doc_id, its name v, n_shingles, and component: the smallest name reachable."""
    found = checkpointed(features(docs, words, bands, depth))
    vertices = found.filter("n > 0").groupBy("set_id").agg(F.min("v").alias("v"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    places = vertices.select("v", "n", F.explode("bands").alias("band"))
    buckets = places.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = checkpointed(places.join(buckets, "band"))
    degree = members.groupBy("v").agg(F.sum("m").alias("degree"))
    ranked = members.join(degree, "v")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("v")).alias("w"), F.col("n").alias("hub_n"))).alias("hub"))
    star = members.join(hubs, "band").select("v", "n", (-F.col("hub.w")).alias("hub"), "hub.hub_n")
    ratio = F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")
    pairs = checkpointed(star.filter((F.col("v") != F.col("hub")) & ratio).select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct())
    both = lambda p: p.select(F.col("a").alias("v")).union(p.select("b")).distinct()
    links = checkpointed(_verified(pairs, _sets(docs, both(pairs), words), percent))
    labels = connected_components(links)

    labelled = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items"))
    mixed = sizes.groupBy("band").agg(F.sum("items").alias("total"), F.max(F.struct("k", "label")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = mixed.select("band", F.col("largest.label").alias("most"), F.ceil(F.col("total") / BLOCK_ITEMS).cast("int").alias("blocks"))
    rest = labelled.join(mixed, "band").withColumn("outside", F.col("label") != F.col("most"))
    home = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    placed = rest.withColumn("home", home).withColumn("block", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    placed = checkpointed(placed.select("band", "block", "v", "n", "label", "outside", (F.col("block") == F.col("home")).alias("own")))
    full = _sets(docs, placed.select("v").distinct(), words).select("v", "items").dropDuplicates(["v", "items"])
    more = placed.join(full, "v").groupBy("band", "block").applyInArrow(_joining(percent), "a long, b long").distinct()
    links = links.union(checkpointed(more))
    labels = connected_components(links)

    # copies of one set follow its vertex; rows of one identifier are one document
    of_set = vertices.select("set_id", F.col("v").alias("rep"))
    rows = found.select("doc_id", "v", "n", "set_id").join(of_set, "set_id", "left")
    rows = rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("label", "rep", "v"))
    return rows.select("doc_id", "v", F.col("n").alias("n_shingles"), "component")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    out = F.when(F.col("component") < NAMELESS, F.col("component"))
    return _components(docs, percent, words, bands, depth).select("doc_id", "n_shingles", out.alias("component_id"), (F.col("v") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, bands: int = 30, depth: int = 4) -> DataFrame:
    """The rows of docs that stay, one document of each component, columns as they are.

    At similarity 0.8 a pair shares none of 30 bands of 4 with probability 1e-7.
    """
    own = F.when(F.col("doc_id").isNull(), F.lit(NAMELESS) + F.shiftrightunsigned(_digest(), 2)).otherwise(F.col("doc_id").cast("long"))
    stay = _components(docs, percent, words, bands, depth).filter(F.col("v") == F.col("component")).select(F.col("v").alias("_name")).distinct()
    return docs.join(stay, own == F.col("_name"), "left_semi").select(*docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
