"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of the rotated vectors are binary codes whose bits share the
variance evenly. Codes are cut into short keys, one table for each. Vectors of a label that share a key in any table are
compared by the Hamming distance of their codes; only (id, code) is shuffled for that. Vectors of what lies within the radius
are then fetched and compared by cosine in double precision.

The keys' length follows the number of vectors of a label, the number of tables from the length and the radius from the
bits: each misses a pair at the threshold with a chance of ``MISS`` at most, if its bits are independent. Sums are not centred, so that
angles are kept: centred codes lost links inside a dominant cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import broadcast_if_small, discard, fraction_of, materialise
from .graph import components
from .grouped import runs

COSINE = 0.93
#: Bound of the sample that rotations are learned on.
SAMPLE = 5000
MISS = 1e-4
#: Vectors that share a key, on average, where keys were evenly used.
PER_KEY = 32
#: Larger buckets are compared in blocks of about this many.
BLOCK = 512
BROADCAST_ROWS = 200_000
#: Bits of a code that travel to the tables.
CARRIED = 128


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """Principal directions turned so that ``sign(x @ r)`` loses least.

    All directions stay and ``x`` is not centred, so angles are kept and near vectors differ in few bits wherever they lie.
    """
    _, _, vt = np.linalg.svd(x, full_matrices=len(x) < x.shape[1])
    w = vt.T
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(w), len(w))))
    v = x @ w
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ t).T
    return w @ r


def radius(bits: int, flip: float, miss: float = MISS) -> int:
    """The Hamming distance that a pair exceeds with a chance of ``miss`` at most, if each bit differs with ``flip``."""
    mass = tail = (1 - flip) ** bits
    r = 0
    while 1 - tail > miss and r < bits:
        mass *= (bits - r) / (r + 1) * flip / (1 - flip)
        tail += mass
        r += 1
    return r


class Tables:
    """Rotations and the bits of each table's key, for vectors of one length."""

    def __init__(self, sample: np.ndarray, per_label: float, cosine: float = COSINE, width: int | None = None):
        bits = sample.shape[1]
        flip = math.acos(cosine) / math.pi
        self.width = min(bits, width or int(min(max(round(math.log2(max(per_label, 1) / PER_KEY)), 4), 20)))
        self.count = math.ceil(math.log(MISS) / math.log(1 - (1 - flip) ** self.width))
        each = max(1, bits // self.width)
        self.rotations = [learn_rotation(sample, seed) for seed in range(math.ceil(self.count / each))]
        self.each = each
        #: Whole tables whose bits are carried.
        self.carried = max(1, min(self.count, CARRIED // self.width))
        self.radius = radius(self.carried * self.width, flip)

    def bits(self, unit: np.ndarray) -> np.ndarray:
        """Rows of ``count`` keys' bits, one after the other."""
        signs = [(unit @ r >= 0)[:, : self.each * self.width] for r in self.rotations]
        return np.concatenate(signs, 1)[:, : self.count * self.width]

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """Rows of keys from the bits of whole tables."""
        return bits.reshape(len(bits), -1, self.width) @ (1 << np.arange(self.width, dtype=np.int64))


def _vectors(batches, kind: str):
    """A fingerprint of label and vector, and the vector's bytes; null where it can link with nothing."""
    for batch in batches:
        column = batch.column(2)
        at = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, "<i4")
        # a null component comes as NaN
        values = column.values.to_numpy(zero_copy_only=False).astype(kind)
        upto = [np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(values), values != 0)]
        bad, some = (x[at[1:]] - x[at[:-1]] for x in upto)
        fits = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False) & (bad == 0) & (some > 0)
        raw, size = values.tobytes(), values.itemsize
        raws = [raw[a * size : b * size] if f else None for a, b, f in zip(at[:-1].tolist(), at[1:].tolist(), fits.tolist())]
        prints = [None if r is None else xxhash.xxh3_128_digest(b"%d:" % k + r) for k, r in zip(batch.column(1).to_pylist(), raws)]
        dims = np.where(fits, at[1:] - at[:-1], 0)
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1), "dim": pa.array(dims, pa.int32()), "print": pa.array(prints, pa.binary()), "v": pa.array(raws, pa.binary())})


def _matrix(column, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bits(column, count: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, count=count)


def _halves(block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are compared with each other: a block with itself, or one with another."""
    first = np.flatnonzero(block == low)
    return first, first if low == high else np.flatnonzero(block == high)


def _first_met(i: np.ndarray, j: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
    """Which pairs share no key of the tables before."""
    fresh = np.ones(len(i), bool)
    for a in range(0, len(i) if table else 0, 65536):
        fresh[a : a + 65536] = ~(keys[i[a : a + 65536], :table] == keys[j[a : a + 65536], :table]).any(1)
    return fresh


def _near_codes(batches, tables: Tables):
    """Rows of each bucket (or two of its blocks) that have another within the radius, first met in this table as far as the carried bits tell."""
    used = tables.carried * tables.width
    for run in runs(batches, KEYS):
        low, high = run.column(3)[0].as_py(), run.column(4)[0].as_py()
        if run.num_rows < 2:
            continue
        bits = _bits(run.column(7), used)
        first, second = _halves(run.column(6).to_numpy(), low, high)
        signs = bits.astype(np.float32) * 2 - 1
        # used - 2 * distance
        near = signs[first] @ signs[second].T >= used - 2 * tables.radius
        if low == high:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = first[i], second[j]
        fresh = _first_met(i, j, tables.keys(bits), min(run.column(1)[0].as_py(), tables.carried))
        own = np.unique(np.concatenate((i[fresh], j[fresh])))
        if len(own):
            yield run.select(range(7)).take(pa.array(own))


def _compare(batches, cosine: float, tables: Tables, kind: str):
    """For each run of a bucket (or of two of its blocks): links first met in this table, and a forest that connects them."""
    for run in runs(batches, KEYS):
        ids, weight = run.column(5).to_numpy(), run.column(7).to_numpy()
        table, low, high = (run.column(c)[0].as_py() for c in (1, 3, 4))
        if len(ids) < 2:
            continue
        unit = _unit(_matrix(run.column(9), kind))
        first, second = _halves(run.column(6).to_numpy(), low, high)
        near = unit[first] @ unit[second].T >= cosine
        if low == high:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = first[i], second[j]
        if len(i):
            fresh = _first_met(i, j, tables.keys(_bits(run.column(8), tables.count * tables.width)), table)
            i, j = i[fresh], j[fresh]
        if not len(i):
            continue
        n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        root = ids.copy()
        while True:
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            if (least == root).all():
                break
            root = least
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cid": pa.array(ids[own]), "n": pa.array(n[own].astype(np.int64)), "root": pa.array(root[own])})


#: A bucket, or two blocks of it.
KEYS = ["label", "tab", "key", "low", "high"]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, width: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal label and length are compared. A null label or vector, one that is zero, empty or has a null or
    non-finite component, and a null id link with nothing. Equal vectors are one class with a weight, so copies are
    never compared. Rows that repeat an id are vectors of their own that link each other if they are equal or near.
    Other columns are ignored; an empty table gives no rows. ``width`` sets the keys' bits, which follow the table's size otherwise.
    """
    spark = vectors.sparkSession
    kind, held = ("<f4", "array<float>") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else ("<f8", "array<double>")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(held).alias("v"))
    base = materialise(map_arrow(source, lambda batches: _vectors(batches, kind), "vec_id long, label long, dim int, print binary, v binary"), "vectors")
    usable = base.filter("print IS NOT NULL AND vec_id IS NOT NULL")
    classes = materialise(usable.groupBy("print").agg(F.min("vec_id").alias("cid"), F.count("*").alias("weight"), F.min("label").alias("label"), F.min("dim").alias("dim"), F.first("v").alias("v")), "vector-classes")
    found = []
    for dim, rows, labels in sorted(tuple(r) for r in classes.groupBy("dim").agg(F.count("*"), F.count_distinct("label")).collect()):
        own = classes.filter(F.col("dim") == dim)
        chosen = own.filter(fraction_of("cid", salt=7) < min(1.0, sample / rows)).select("cid", "v").collect()
        chosen = sorted(chosen)[: 2 * sample] or own.select("cid", "v").limit(1).collect()
        tables = Tables(_unit(np.frombuffer(b"".join(bytes(r["v"]) for r in chosen), kind).reshape(-1, dim).astype(np.float64)), rows / labels, cosine, width)
        found.append(_links(own, tables, cosine, kind, broadcast_rows))
    hits = None
    for f in found:
        hits = f if hits is None else hits.union(f)
    if hits is None:
        hits = spark.createDataFrame([], "cid long, n long, root long")
    hits = materialise(hits, "vector-links")
    label = components(hits.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = hits.groupBy("cid").agg(F.sum("n").alias("n"))
    named = classes.select("print", "cid", "weight").join(counts, "cid", "left").join(label.toDF("cid", "component"), "cid", "left")
    named = named.select("print", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    out = base.select("vec_id", "print").join(named, "print", "left")
    component = F.coalesce("component", "vec_id")
    out = out.withColumns({"n_links": F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long"), "component_id": F.when(F.col("vec_id").isNotNull(), component)})
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, tables: Tables, cosine: float, kind: str, broadcast_rows: int) -> DataFrame:
    """(cid, n, root): weighted links of a class found in one bucket, and a class that it is connected to."""
    used = tables.carried * tables.width

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                bits = tables.bits(_unit(_matrix(batch.column(3), kind)))
                whole, short = np.packbits(bits, axis=1), np.packbits(bits[:, :used], axis=1)
                keys = tables.keys(bits).astype(np.int32)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables.count, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in whole], pa.binary()), pa.array([k.tobytes() for k in short], pa.binary()), each], [*batch.schema.names, "code", "short", "each"])

    coded = materialise(map_arrow(classes.select("cid", "weight", "label", "v"), code, "cid long, weight long, label long, v binary, code binary, short binary, each array<int>"), "vector-codes")
    spread = coded.select("label", F.posexplode("each").alias("tab", "key"), "cid", "short")
    hot = materialise(spread.groupBy("label", "tab", "key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), "vector-hot")
    spread = spread.join(broadcast_if_small(hot, hot.count(), broadcast_rows), ["label", "tab", "key"], "left")
    spread = spread.withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("label", "tab", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "cid", "block", "short")
    near = map_arrow(spread.repartition(*KEYS).sortWithinPartitions(*KEYS), lambda batches: _near_codes(batches, tables), "label long, tab int, key int, low int, high int, cid long, block int")
    near = materialise(near, "vector-candidates")
    fetched = near.join(coded.select("cid", "weight", "code", "v"), "cid").select(*KEYS, "cid", "block", "weight", "code", "v")
    out = materialise(map_arrow(fetched.repartition(*KEYS).sortWithinPartitions(*KEYS), lambda batches: _compare(batches, cosine, tables, kind), "cid long, n long, root long"), "vector-found")
    for t in (coded, hot, near):
        discard(t)
    return out
