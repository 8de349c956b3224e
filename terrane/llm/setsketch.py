"""Near-duplicate documents by SetSketch registers over word shingles.

A register keeps the minimum of an exponential hash over the document's shingles, as a truncated exponent of base
``BASE``; registers of unions are maxima of registers, so sketches merge. Equal registers mark similar sets. Bands of
registers give candidates, the likelihood of the joint registers thins them, and full shingle sets confirm links.

Documents with equal sets are one class before anything is compared. Inside a bucket members are first compared with
one pivot, so a bucket costs as many comparisons as it has members. Only classes that are still in different components
after two such rounds are compared pair by pair, in blocks where a bucket is large, so no candidate of any band
goes untested unless its two classes are already connected.

Texts are read as bytes, in slices: nothing is held of a text but the hashes of its words. Full sets are compared by streaming
those of at most ``GROUP`` documents past the set of the one that they are compared with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import broadcast_if_small, discard, materialise, without
from .graph import components
from .grouped import runs
from .words import release

WORDS = 5
BANDS, ROWS = 32, 5
#: The first BANDS * ROWS make the bands; all serve the likelihood.
REGISTERS = 256
#: SetSketch parameters: base, rate of the exponential hash, largest exponent.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A candidate goes when its registers are exp(LIKELIHOOD) times likelier under some lower similarity than under any admissible one.
LIKELIHOOD = 12.0
#: Buckets of more members are compared in blocks of this many.
BLOCK = 256
SMALL_BUCKET = 64
#: Documents whose full sets are compared with one set in one task.
GROUP = 512
#: Rows of ids (24 bytes at most) that may be broadcast to pick the texts of candidates; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that are hashed at once, bytes of whole texts whose words are held at once, and bytes of a batch that is given back.
SLICE, CHUNK, BATCH = 1 << 16, 1 << 20, 1 << 22

_draw = np.random.default_rng(20)
XOR = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
ODD = (_draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)
#: A value for each byte, equal for A-Z and a-z; a word's hash is the sum of its bytes' values times powers of STEP.
VALUE = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[65:91] = VALUE[97:123]
SOLID = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
STEP = 0x9E3779B97F4A7C15
POWER = np.cumprod(np.array([1] + [STEP] * (SLICE - 1), np.uint64))
INVERSE = np.cumprod(np.array([1] + [pow(STEP, -1, 1 << 64)] * (SLICE - 1), np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of word hashes; ``parts[k]`` holds the sequences' k-th words."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie side by side in ``data``, and the number of words before each of ``cuts``.

    Text i goes from ``cuts[i]`` to ``cuts[i + 1]``. Bytes are hashed ``SLICE`` at a time; a word that a slice leaves unfinished
    is carried on in the next one.
    """
    found, before, begun = [], np.zeros(len(cuts), np.int64), 0
    left: tuple | None = None  # hash and length of an unfinished word
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        n = len(part)
        low, high = np.searchsorted(cuts, (a, a + n))
        own = cuts[low:high] - a
        last = np.searchsorted(cuts, a + n, "right")
        solid = SOLID[part]
        begin, end = np.ones(n, bool), np.ones(n, bool)
        np.logical_not(solid[:-1], out=begin[1:])
        np.logical_not(solid[1:], out=end[:-1])
        begin[own] = True
        ends = cuts[low:last] - a
        end[ends[ends > 0] - 1] = True
        start, stop = np.flatnonzero(begin & solid), np.flatnonzero(end & solid) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUE[part] * POWER[:n], out=sums[1:])
        h, size = (sums[stop] - sums[start]) * INVERSE[start], stop - start
        open_ = bool(len(stop)) and stop[-1] == n and last == high and a + n < len(data)
        if left is not None:
            if len(start) and start[0] == 0 and not (len(own) and own[0] == 0):
                h[0] = np.uint64((left[0] + int(h[0]) * pow(STEP, left[1], 1 << 64)) % (1 << 64))
                size[0] += left[1]
                start = start[1:]
            else:
                h, size = np.concatenate(([np.uint64(left[0])], h)), np.concatenate(([left[1]], size))
        before[low:high] = begun + np.searchsorted(start, own)
        begun += len(start)
        left = (int(h[-1]), int(size[-1])) if open_ else None
        keep = len(h) - open_
        found.append(_mix(h[:keep] + size[:keep].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    before[np.searchsorted(cuts, len(data)) :] = begun
    return np.concatenate(found) if found else np.zeros(0, np.uint64), before


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes, sorted, of each text: ``WORDS`` words, or all words where there are fewer.

    Whole texts of about ``CHUNK`` bytes are hashed together, or one text that is longer.
    """
    if not len(texts):
        return
    _, places, raw = texts.buffers()
    kind, here = np.dtype("<i8" if pa.types.is_large_string(texts.type) else "<i4"), texts.offset
    at = np.frombuffer(places, kind, len(texts) + 1, here * kind.itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        flat, before = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        spans = np.empty(max(0, len(flat) - WORDS + 1), np.uint64)
        for a in range(0, len(spans), SLICE):
            b = min(a + SLICE, len(spans))
            spans[a:b] = chain([flat[a + k : b + k] for k in range(WORDS)])
        for k, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
            if a == b or null[i + k]:
                yield flat[:0]
            elif b - a < WORDS:
                yield chain([flat[x : x + 1] for x in range(a, b)])
            else:
                s = np.sort(spans[a : b - WORDS + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        i = j


_held = np.empty((256, REGISTERS), np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: ``REGISTERS`` unsigned 16-bit exponents."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), len(_held)):
        own = x[i : i + len(_held), None]
        h = _held[: len(own)]
        np.bitwise_xor(own, XOR, out=h)
        np.multiply(h, ODD, out=h)
        np.minimum(least, h.min(0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def admissible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sketches (rows of ``a`` and ``b``) of sets of known sizes may come from sets that link.

    The likelihood of how many registers are greater, smaller and equal is compared between similarities from
    ``percent`` on and those below. Sizes alone rule out pairs that cannot link.
    """
    least, m = percent / 100, a.shape[1]
    # far fewer equal registers than any admissible pair has: seven deviations
    near = np.flatnonzero((a == b).sum(1) >= m * least - 7 * np.sqrt(m * least * (1 - least)))
    out = np.zeros(len(a), bool)
    if not len(near):
        return out
    a, b, na, nb = a[near], b[near], na[near].astype(np.float64), nb[near].astype(np.float64)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = m - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def p(x):
        return -np.log(1 - np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def best(low, high):
        out = np.full(len(a), -np.inf)
        for s in np.linspace(0, 1, 24):
            j = low + (high - low) * s
            pa_, pb_ = p(u - v * j), p(v - u * j)
            out = np.maximum(out, more * np.log(pa_) + less * np.log(pb_) + same * np.log(np.maximum(1 - pa_ - pb_, 1e-12)))
        return out

    possible = top >= least - 1e-9
    high = best(np.full(len(a), least), np.maximum(top, least))
    out[near] = possible & (high + LIKELIHOOD >= best(np.zeros(len(a)), np.full(len(a), least)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _sketches(batches):
    release()
    for batch in batches:
        n, prints, sketches = [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "print": pa.array(prints, pa.binary()), "sketch": pa.array(sketches, pa.binary())})


def _sets(batches):
    """The columns but the last, which is the text, and the text's set: bytes of unsigned 64-bit numbers, never empty."""
    for batch in batches:
        rows, sets, held = [], [], 0
        for i, s in enumerate(shingle_sets(batch.column(batch.num_columns - 1))):
            if len(s):
                rows.append(i)
                sets.append(s.tobytes())
                held += s.nbytes
            if held > BATCH or i == batch.num_rows - 1:
                own = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "shingles"])
                rows, sets, held = [], [], 0


def _arrays(batches):
    """``_sets`` with the sets as arrays."""
    for batch in _sets(batches):
        column = batch.column(batch.num_columns - 1)
        at = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1) // 8
        sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(column.buffers()[2] or b"", "<i8", at[-1])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], batch.schema.names)


def _thin(batches, percent: int):
    for batch in batches:
        if batch.num_rows:
            keep = admissible(_matrix(batch.column(4)), _matrix(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _links(batches, percent: int):
    """Links from rows (hub, part, member, shingles), sorted: in each part of a hub its own set comes first, with a null member."""
    group, sets = None, []
    for batch in batches:
        hubs, parts, members = (batch.column(i).to_pylist() for i in range(3))
        a, b = [], []
        for i, member in enumerate(members):
            s = np.frombuffer(batch.column(3)[i].as_buffer(), "<u8")
            if (hubs[i], parts[i]) != group:
                group, sets = (hubs[i], parts[i]), []
            if member is None:
                # rows that repeat an id: every set that it has counts, once
                if not any(len(x) == len(s) and (x == s).all() for x in sets):
                    sets.append(s.copy())
                continue
            for x in sets:
                if 100 * min(len(x), len(s)) >= percent * max(len(x), len(s)):
                    both = shared(x, s)
                    if 100 * both >= percent * (len(x) + len(s) - both):
                        a.append(hubs[i])
                        b.append(member)
                        break
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _blocks(batches, percent: int):
    """For each run of two blocks of a bucket, or of one: admissible pairs of different components."""
    for run in runs(batches, ["bucket", "low", "high"]):
        low, high = run.column(1)[0].as_py(), run.column(2)[0].as_py()
        block, rep, component, shared, n = (run.column(c).to_numpy() for c in range(3, 8))
        sketch, band = _matrix(run.column(8)), run.column(9)[0].as_py()
        bands = sketch[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        for i in first:
            other = (component[second] != component[i]) & ((100 + percent) * np.minimum(shared[i], shared[second]) >= percent * (n[i] + n[second]))
            j = second[other & (rep[second] > rep[i])] if low == high else second[other]
            # a pair comes from the first band that it shares, and from no other
            j = j[(bands[j] == bands[i]).all(2).argmax(1) == band]
            if len(j):
                ok = j[admissible(np.broadcast_to(sketch[i], (len(j), REGISTERS)), sketch[j], np.full(len(j), n[i]), n[j], percent)]
                found.append((np.full(len(ok), rep[i]), rep[ok]))
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([f[0] for f in found])), "b": pa.array(np.concatenate([f[1] for f in found]))})


def mixed(named: DataFrame) -> DataFrame:
    """Rows (bucket, component, ...) of the buckets whose members are in different components."""
    low_high = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(low_high.filter("low <> high").select("bucket"), "bucket")


class Linker:
    """Holds the tables of one run."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.base = materialise(map_arrow(self.docs, _sketches, "doc_id long, n long, print binary, sketch binary"), "sketches")
        classes = self.base.filter("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = materialise(classes, "sketch-classes")
        size = 2 * ROWS
        bucket = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", size * i + 1, size)) for i in range(BANDS)]))
        spread = self.classes.select("rep", "n", bucket.alias("band", "bucket"))
        pivots = spread.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
        self.members = materialise(spread.join(pivots, "bucket"), "sketch-buckets")
        self.label: DataFrame | None = None

    def admit(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches may come from sets that link."""
        k = self.classes.select("rep", "n", "sketch")
        joined = pairs.join(k.toDF("a", "na", "ka"), "a").join(k.toDF("b", "nb", "kb"), "b").select("a", "b", "na", "nb", "ka", "kb")
        return map_arrow(joined, partial(_thin, percent=self.percent), "a long, b long")

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """The texts of documents, with the columns of ``ids`` (id, ...): once for each of its rows."""
        return self.docs.join(broadcast_if_small(ids, ids.count(), BROADCAST_ROWS), F.col("doc_id") == F.col("id")).select(*ids.columns, "text")

    def confirm(self, pairs: DataFrame) -> None:
        """Keep the pairs (a, b) that link by their full sets as edges.

        Each a is a hub: its set goes once to every part of at most about ``GROUP`` of its partners, whose sets stream past it.
        """
        pairs = materialise(pairs.toDF("hub", "member"), "pairs")
        hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
        members = pairs.join(hubs, "hub").select(F.col("member").alias("id"), "hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member")
        own = hubs.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"))
        wanted = materialise(members.union(own), "pair-ids")
        sets = map_arrow(self.texts_of(wanted).drop("id"), _sets, "hub long, part int, member long, shingles binary")
        sets = sets.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
        links = materialise(map_arrow(sets, partial(_links, percent=self.percent), "a long, b long"), "links")
        if self.label is not None:
            links, before = materialise(links.union(self.label.filter("node <> component")), "links"), links
            discard(before)
            discard(self.label)
        self.label = components(links)
        for t in (pairs, wanted, links):
            discard(t)

    def labels(self) -> DataFrame:
        """(node, component) so far."""
        return self.docs.sparkSession.createDataFrame([], "node long, component long") if self.label is None else self.label

    def prune(self, named: DataFrame) -> DataFrame:
        """Rows of mixed buckets whose class may still link with another of its bucket, with ``shared``.

        A shingle that no other class of these buckets holds is common to no pair, so a class shares ``shared`` shingles
        at most: its size less its own ones. What cannot reach the percentage with the smallest member goes.
        """
        ids = materialise(named.select(F.col("rep").alias("id")).distinct(), "mixed-ids")
        sets = materialise(map_arrow(self.texts_of(ids), _arrays, "id long, shingles array<bigint>").withColumn("row", F.monotonically_increasing_id()), "mixed-sets")
        single = sets.select("row", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("k"), F.min("row").alias("row")).filter("k = 1")
        own = sets.select("row", "id").join(single.groupBy("row").agg(F.count("*").alias("own")), "row", "left").groupBy("id").agg(F.min(F.coalesce("own", F.lit(0))).alias("own"))
        out = named.join(own, named["rep"] == own["id"], "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("id", "own")
        least = out.groupBy("bucket").agg(F.min("n").alias("least"))
        out = materialise(out.join(least, "bucket").filter(f"{100 + self.percent} * shared >= {self.percent} * (n + least)").drop("least"), "shared-buckets")
        discard(sets)
        discard(ids)
        return mixed(out)

    def run(self) -> DataFrame:
        pivots = self.members.filter("rep <> pivot")
        # each class against the first of its pivots
        self.confirm(self.admit(pivots.groupBy("rep").agg(F.min("pivot").alias("pivot")).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))))
        # against its other pivots, where they are not connected yet
        now = self.labels()
        rest = pivots.groupBy("rep", "pivot").agg(F.count("*").alias("k")).join(pivots.groupBy("rep").agg(F.min("pivot").alias("first")), "rep").filter("pivot <> first")
        rest = rest.join(now.toDF("rep", "c1"), "rep", "left").join(now.toDF("pivot", "c2"), "pivot", "left").filter("coalesce(c1, rep) <> coalesce(c2, pivot)")
        self.confirm(self.admit(rest.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))))
        # what is left: pairs of a bucket in different components
        named = self.members.filter("size > 2").join(self.labels().toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = materialise(mixed(named), "mixed-buckets")
        if named.isEmpty():
            return self.labels()
        pruned = materialise(self.prune(named), "pruned-buckets")
        discard(named)
        named = pruned
        if named.isEmpty():
            return self.labels()
        small = named.filter(F.col("size") <= SMALL_BUCKET)
        x, y = small.select("bucket", "pivot", F.col("rep").alias("a"), F.col("component").alias("c1"), F.col("n").alias("n1"), F.col("shared").alias("s1")), small.select("bucket", F.col("rep").alias("b"), F.col("component").alias("c2"), F.col("n").alias("n2"), F.col("shared").alias("s2"))
        near = x.join(y, "bucket").filter(f"a < b AND c1 <> c2 AND a <> pivot AND {100 + self.percent} * least(n1, n2, s1, s2) >= {self.percent} * (n1 + n2)").select("a", "b")
        found = self.admit(near.distinct())
        large = named.filter(F.col("size") > SMALL_BUCKET)
        if not large.isEmpty():
            n = F.ceil(F.col("size") / BLOCK).cast("int")
            large = large.withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
            large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
            large = large.select("bucket", "low", "high", "block", "rep", "component", "shared", "band").join(self.classes.select("rep", "n", "sketch"), "rep").select("bucket", "low", "high", "block", "rep", "component", "shared", "n", "sketch", "band")
            keys = ["bucket", "low", "high"]
            large = large.repartition(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
            found = found.union(map_arrow(large, partial(_blocks, percent=self.percent), "a long, b long"))
        self.confirm(found.distinct())
        discard(named)
        return self.labels()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. Rows with equal ids count as one document, which is
    linked with whatever any of its texts links with; each row has its own text's ``n_shingles``. A null
    id gives a null component and is kept. Repeated rows come back as often as they are; texts of any length are read in
    slices; other columns are ignored; an empty table gives no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return _linked(docs, percent)
    # a key of id and text stands for the id, so that each text is looked up by its own
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key")), "keyed-rows")
    found = materialise(_linked(docs.select(key.alias("doc_id"), "text"), percent), "keyed-components")
    texts = found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), F.col("n_shingles").alias("n"), F.col("component_id").alias("piece")).distinct()
    named = materialise(rows.filter("key IS NOT NULL").distinct().join(texts, "key").select("id", "piece").distinct(), "keyed-pieces")
    # the components of one document's texts are one
    whole = components(named.join(named.groupBy("id").agg(F.min("piece").alias("b")), "id").select(F.col("piece").alias("a"), "b")).toDF("piece", "whole")
    named = named.join(whole, "piece", "left").select("id", F.coalesce("whole", "piece").alias("whole")).distinct()
    least = named.join(named.groupBy("whole").agg(F.min("id").alias("component_id")), "whole").select("id", "component_id")
    out = rows.filter("key IS NOT NULL").join(texts.select("key", "n"), "key").join(least, "id").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(found.filter("doc_id IS NULL"))


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` of rows whose ids differ wherever their texts do."""
    link = Linker(docs, percent)
    label = link.run()
    by_print = link.classes.select("print", "rep").join(label.toDF("rep", "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = link.base.select("doc_id", "n", "print").join(by_print, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component; all columns stay, and so do null ids."""
    return without(docs, near_duplicates(docs, percent).filter("NOT kept").select("doc_id"))
