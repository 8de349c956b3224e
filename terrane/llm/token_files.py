"""Token ids in patched frame-of-reference files.

A file is a row of bytes ("segment") in a Parquet container, so that writing is atomic and survives lost
executors. A segment holds about ``SEGMENT_TOKENS`` ids of whole documents in ascending doc_id order:

    magic "TPF1" | u32 documents | u64 ids | u64 ids of this part before it
    i64 doc_id[documents] | u8 doc_id is null[documents] | u32 ids[documents]
    u32 first byte of the block's payload[blocks + 1] | u32 minimum[blocks] | u8 width[blocks] | u8 exceptions[blocks]
    payload: 128 values of ``width`` bits a block, low bits first
    u8 position[exceptions] | u32 value minus minimum[exceptions]

Each block of 128 ids has its minimum subtracted. The width is what ``PERCENTILE`` of its values need; values that
need more are kept in the exception list, and their packed bits are 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import materialise
from .tokens import END, encoder
from .words import text_chunks

MAGIC = b"TPF1"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 20


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """Block index, minima, widths, exception counts, payload and exception lists of ``ids``."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<I", 0)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    values = padded.reshape(blocks, BLOCK)
    least = values.min(1)
    values = values - least[:, None]
    rank = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(values, rank, axis=1)[:, rank])
    outlier = values >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    counts = outlier.sum(1).astype(np.uint8)
    where = np.nonzero(outlier)
    exceptions = values[where]
    values[where] = 0
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * (BLOCK // 8), out=starts[1:])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        columns = np.ascontiguousarray(values[own].T).astype(np.uint64)
        words = np.zeros((BLOCK * int(w) // 64, len(own)), np.uint64)
        for i in range(BLOCK):
            at, shift = divmod(i * int(w), 64)
            words[at] |= columns[i] << np.uint64(shift)
            if shift + int(w) > 64:
                words[at + 1] |= columns[i] >> np.uint64(64 - shift)
        raw = np.ascontiguousarray(words.T).view(np.uint8)
        payload[starts[own][:, None] + np.arange(raw.shape[1], dtype=np.uint32)] = raw
    return b"".join((struct.pack("<I", blocks), starts.astype("<u4").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), payload.tobytes(), where[1].astype(np.uint8).tobytes(), exceptions.astype("<u4").tobytes()))


def unpack_ids(data: memoryview, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack_ids`` wrote."""
    (blocks,) = struct.unpack_from("<I", data)
    if not blocks:
        return np.zeros(0, np.uint32)
    at = 4

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    starts, least, width, counts = take("<u4", blocks + 1), take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    payload = take("u1", int(starts[-1]))
    total = int(counts.sum(dtype=np.int64))
    position, exceptions = take("u1", total), take("<u4", total)
    values = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        raw = payload[starts[own][:, None] + np.arange(BLOCK // 8 * int(w), dtype=np.uint32)]
        words = np.ascontiguousarray(raw.view(np.uint64).T)
        columns = np.empty((BLOCK, len(own)), np.uint32)
        mask = np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK):
            a, shift = divmod(i * int(w), 64)
            got = words[a] >> np.uint64(shift)
            if shift + int(w) > 64:
                got = got | (words[a + 1] << np.uint64(64 - shift))
            columns[i] = (got & mask).astype(np.uint32)
        values[own] = columns.T
    values[np.repeat(np.arange(blocks), counts), position] = exceptions
    return (values + least[:, None]).reshape(-1)[:n]


def write_segment(doc_ids: list, documents: list, before: int) -> bytes:
    """One segment from the ids (bytes of unsigned 32-bit) of whole documents."""
    sizes = np.array([len(d) // 4 for d in documents], "<u4")
    ids = np.frombuffer(b"".join(documents), "<u4")
    return b"".join((MAGIC, struct.pack("<IQQ", len(documents), len(ids), before), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), sizes.tobytes(), pack_ids(ids)))


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids of each document, all ids, and the ids of the part before this segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, total, before = struct.unpack_from("<IQQ", data, 4)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, "u1", n, at + 8 * n)
    sizes = np.frombuffer(data, "<u4", n, at + 9 * n)
    ids = unpack_ids(memoryview(data)[at + 13 * n :], total)
    return [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist())], sizes, ids, before


def write_token_files(docs: DataFrame, vocabulary: str, partitions: int | None = None) -> DataFrame:
    """Encode all ``docs`` (doc_id, text) and write segments (part, segment, n_tokens, data) in ascending doc_id order.

    Null texts are empty, null ids come first, rows that repeat an id stay side by side in text order, and other
    columns are ignored. Only ``partitions`` decides which part holds what; parts are ranges of doc_id.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(source.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = source.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches):
        tokens, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        number = before = held = 0
        ids, documents = [], []

        def flush():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_tokens": pa.array([held], pa.int64()), "data": pa.array([write_segment(ids, documents, before)], pa.binary())})

        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                ids += batch.column(0).slice(a, b - a).to_pylist()
                documents += [x + end for x in tokens.encode_many(texts)]
                held += sum(len(x) for x in documents[a - b :]) // 4
                if held >= SEGMENT_TOKENS:
                    yield flush()
                    number, before, held, ids, documents = number + 1, before + held, 0, [], []
        if documents:
            yield flush()

    return materialise(map_arrow(ranged, encode, "part int, segment int, n_tokens long, data binary"), "token-files", "uncompressed")


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode segments to (doc_id, start, n_tokens, ids_crc32); start counts the ids of all documents before it.

    The driver gets one total for each part, of which there are as many as partitions.
    """
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    first, so_far = {}, 0
    for part, n in totals:
        first[part] = so_far
        so_far += n

    def decode(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, sizes, ids, before = read_segment(data.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                starts = ends - sizes
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + (first[part] + before), pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array(checks, pa.int64())})

    return map_arrow(files.select("part", "data"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
