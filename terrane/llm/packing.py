"""Packing along a space-filling curve: similar documents lie side by side in fixed-length sequences.

A document's vector is the sum of one fixed random direction for each hashed token id, scaled by the root of its
length. Its few coordinates are squashed to a grid and joined to a Hilbert key; documents sorted by that key
form one stream of ids, which is cut every ``length`` ids. So no sequence but the last has padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import discard, materialise
from .tokens import END, encoder
from .words import text_chunks

LENGTH = 2048
DIMENSIONS = 3
GRID_BITS = 16


def hilbert_keys(grid: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Hilbert index of each row of an unsigned integer grid, by Skilling's transposed form."""
    x = [grid[:, i].astype(np.uint64) for i in range(grid.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[-1] & np.uint64(1 << b)) != 0, t ^ np.uint64((1 << b) - 1), t)
    x = [c ^ t for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << one) | ((c >> np.uint64(b)) & one)
    return out


def directions(seed: int = 17, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random direction for each of 65,536 hashed ids."""
    return np.random.default_rng(seed).standard_normal((1 << 16, dimensions)).astype(np.float32)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pack (doc_id, text) into sequences; one row for each piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids (the piece's ids) unless they are not asked for. Null texts are empty and give their end id alone; every row counts, repeated ids
    and texts included; other columns are ignored; an empty table gives no rows.

    Texts are encoded once. The rows, whose ids take 16 bits each, are range-sorted by key in one shuffle, and each part counts
    its own ids; the driver gets one total a part, of which there are as many as shuffle partitions.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches):
        tokens, part, row = encoder(vocabulary), TaskContext.get().partitionId(), 0
        # a column for each coordinate, in the order of ids instead of hashes
        hashed = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(16)
        columns, end = list(np.ascontiguousarray(directions()[hashed].T)), np.array([END], "<u4").tobytes()
        if len(tokens.closes) > 1 << 16:
            raise ValueError("ids are held as unsigned 16-bit numbers")
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                raw = [x + end for x in tokens.encode_many(texts)]
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                ids = np.frombuffer(b"".join(raw), "<u4")
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                vectors = np.stack([np.add.reduceat(c[ids], first) for c in columns], 1) / np.sqrt(sizes)[:, None]
                grid = ((np.tanh(vectors / 2) + 1) / 2 * ((1 << GRID_BITS) - 1)).astype(np.uint64)
                short = ids.astype("<u2")
                at = (np.concatenate((first, [len(ids)])) * 2).tolist()
                data = short.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array((np.int64(part) << 32) + np.arange(row, row + len(raw))),
                    "doc_id": batch.column(0).slice(a, b - a),
                    "doc_tokens": pa.array(sizes),
                    "key": pa.array(hilbert_keys(grid).astype(np.int64)),
                    "data": pa.array([data[x:y] for x, y in zip(at, at[1:])], pa.binary()),
                })
                row += len(raw)

    tokens = materialise(map_arrow(source, encode, "row long, doc_id long, doc_tokens long, key long, data binary"), "pack-ids")

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes)], [*batch.schema.names, "part", "at"])
            at = int(ends[-1]) if len(ends) else at

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, "key", "row").sortWithinPartitions("key", "row").select("doc_id", "doc_tokens", "data")
    placed = materialise(map_arrow(ordered, place, "doc_id long, doc_tokens long, data binary, part int, at long"), "pack-order")
    discard(tokens)
    first, so_far = {}, 0
    for part, size in sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("doc_tokens")).collect()):
        first[part] = so_far
        so_far += size

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)}
            for doc_id, size, data, part, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw, start, at = np.frombuffer(data, "<u2").astype("<u4").tobytes(), 0, first[part] + at
                while start < size:
                    sequence, offset = divmod(at + start, length)
                    n = min(size - start, length - offset)
                    piece = raw[4 * start : 4 * (start + n)]
                    for k, v in zip(out, (doc_id, start, n, zlib.crc32(piece), size, sequence, offset, piece)):
                        out[k].append(v)
                    start += n
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(placed, cut, f"{schema}, ids binary" if with_ids else schema)
