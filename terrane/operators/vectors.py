"""Exact work on all pairs of vectors: rows packed into blocks, blocks that cannot matter left out, matrix products.

A block is one row of a table: the ids and the matrix of some hundreds of vectors, so a shuffle moves blocks and not vectors
one by one. Pairs of blocks are dealt to a square of tiles, whose side does not grow with the vectors: a block is sent once for
each row and column of tiles, so what is shuffled grows as the vectors do. A task holds the blocks of one tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from ..shipping import map_arrow, ship

#: Most pivots, most numbers of a block's matrix, and of the vectors in a row of tiles.
PIVOTS, NUMBERS, STRIPE = 64, 1 << 17, 1 << 25

PACKED = "b int, pivot int, n int, ids binary, groups binary, x binary, bound double, low array<double>, high array<double>"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y`` by their norms and one matrix product; near 0 they are computed anew."""
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2
    d += a[:, None]
    d += b
    i, j = np.nonzero(d <= 1e-6 * (a.max(initial=0) + b.max(initial=0)))
    small = d[i, j] <= 1e-6 * (a[i] + b[j])
    i, j = i[small], j[small]
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return d


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _places(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``j`` those of ``i`` are that it holds, and their own places."""
    by = np.argsort(j, kind="stable")
    at = by[np.minimum(np.searchsorted(j[by], i), len(j) - 1)]
    itself = np.flatnonzero(j[at] == i)
    return at[itself], itself


def pack(vectors: DataFrame, k: int = 0, rows: int | None = None, group: str | None = None) -> tuple[DataFrame, int]:
    """Blocks of vectors (id, v[, group]) as a table, and the length of a vector.

    With ``k``, vectors are dealt to the nearest of at most ``PIVOTS`` sampled vectors, and each pivot's vectors by their ids to
    blocks of about ``rows``. A block then has its least and greatest distance to every pivot, and ``bound``: no row's ``k``
    nearest rows are further away than that. Without ``k`` vectors are dealt by their ids alone. Rows without id or vector are left out.
    """
    ship(vectors.sparkSession)
    some = vectors.select("id", F.col("v").cast("array<double>").alias("v"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g")).filter("id IS NOT NULL AND v IS NOT NULL")
    n = some.count()
    sample = [r["v"] for r in some.orderBy(F.xxhash64("id"), "id").limit(PIVOTS if k else 1).collect()]
    width = len(sample[0]) if sample else 1
    rows = rows or max(16, min(1024, NUMBERS // max(1, width)))
    pivots = np.array(sample[: max(1, min(PIVOTS, n // rows))], np.float64).reshape(-1, width)

    def nearest(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            p = squares(x, pivots).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32))], [*batch.schema.names, "pivot"])

    if k and len(pivots) > 1:
        # the table is counted and then read, so rows keep their pivot though an executor is lost
        dealt = materialise(map_arrow(some, nearest, "id long, v array<double>, g long, pivot int"), "vectors")
        found = sorted((r["pivot"], r["n"]) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect())
    else:
        dealt, found = some.withColumn("pivot", F.lit(0)), [(0, n)]
    starts, at = [], 0
    for p, m in found:
        parts = -(-m // rows)
        starts += [F.lit(p), F.struct(F.lit(at).alias("first"), F.lit(max(1, parts)).alias("parts"))]
        at += max(1, parts)
    own = F.create_map(*starts)[F.col("pivot")]
    block = (own["first"] + F.pmod(F.xxhash64("id"), own["parts"].cast("long"))).cast("int").alias("b")

    def packed(key, table):
        order = np.argsort(table["id"].to_numpy())
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
        ids, groups = table["id"].to_numpy()[order].astype(np.int64), table["g"].fill_null(-1).to_numpy()[order].astype(np.int64)
        far = np.sqrt(np.maximum(squares(x, pivots), 0)) if k else np.zeros((1, 1))
        bound = np.inf
        if 0 < k < len(x):
            # one more than k, as a row may not count itself
            bound = float(np.sqrt(max(0.0, np.partition(squares(x, x), k, axis=1)[:, k].max())))
        return pa.table({"b": [key[0].as_py()], "pivot": [int(table["pivot"][0].as_py())], "n": [len(ids)], "ids": [ids.tobytes()], "groups": [groups.tobytes()], "x": [np.ascontiguousarray(x).tobytes()], "bound": [bound], "low": [far.min(0).tolist()], "high": [far.max(0).tolist()]}).cast(_SCHEMA)

    out = materialise(dealt.select(block, "pivot", "id", "v", "g").groupBy("b").applyInArrow(packed, PACKED), "vector-blocks")
    if hasattr(dealt, "_scratch_path"):
        discard(dealt)
    return out, width


_SCHEMA = pa.schema([("b", pa.int32()), ("pivot", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("groups", pa.binary()), ("x", pa.binary()), ("bound", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(b, c): for each block those that may hold one of its rows' nearest rows, itself included.

    By the triangle inequality rows of two blocks are at least as far apart as their distances to any pivot differ. Pivots
    are held against each other first, by the extremes of their blocks, and then only the blocks of those that are left.
    """
    spark = blocks.sparkSession
    ends = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)
    first = blocks.select("low").first()
    width = len(first["low"]) if first else 1
    by_pivot = blocks.groupBy("pivot").agg(ends(F.min, "low"), ends(F.max, "high"), F.max("bound").alias("bound")).collect()
    near = [(p["pivot"], q["pivot"]) for p in by_pivot for q in by_pivot if max(max(a - d, c - b) for a, b, c, d in zip(p["low"], p["high"], q["low"], q["high"])) <= p["bound"] + 1e-9]
    pairs = spark.createDataFrame(near, "pivot int, other int")
    of = blocks.select("pivot", "b", "bound", "low", "high")
    them = blocks.select(F.col("pivot").alias("other"), F.col("b").alias("c"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    least = F.array_max(F.concat(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y)))
    return of.join(pairs, "pivot").join(them, "other").filter(least <= F.col("bound") + 1e-9).select("b", "c")


def _meetings(blocks: DataFrame, pairs: DataFrame, width: int):
    """Tiles as groups of rows (p, q, b, partners, ids, groups, x): the blocks ``b`` of a tile with the blocks that each is compared
    with, which are the tile's rows without ``partners``.

    A square of tiles has enough of them for all cores, and more only if a row of tiles would hold too many numbers.
    """
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    side = max(1, min(size["blocks"], max(math.ceil(math.sqrt(4 * blocks.sparkSession.sparkContext.defaultParallelism)), -(-(size["n"] or 0) * width // STRIPE))))
    columns = ["ids", "groups", "x"]
    dealt = pairs.select(F.pmod("b", F.lit(side)).alias("p"), F.pmod("c", F.lit(side)).alias("q"), "b", "c")
    mine = dealt.groupBy("p", "q", "b").agg(F.collect_list("c").alias("partners")).join(blocks.select("b", *columns), "b")
    theirs = dealt.select("p", "q", F.col("c").alias("b")).distinct().join(blocks.select("b", *columns), "b").withColumn("partners", F.lit(None).cast("array<int>"))
    return mine.select("p", "q", "b", "partners", *columns).union(theirs.select("p", "q", "b", "partners", *columns)).groupBy("p", "q")


def _tile(table: pa.Table, width: int):
    """(b, ids, groups, x, partners) of a tile's blocks, with (ids, groups, x) of each partner."""
    read = lambda row: (_numbers(row["ids"]), _numbers(row["groups"]), _matrix(row["x"], width))
    other = table.filter(table["partners"].is_null())
    at = {b: i for i, b in enumerate(other["b"].to_pylist())}
    own = table.filter(table["partners"].is_valid())
    for i in range(len(own)):
        row = own.slice(i, 1)
        yield *read(row), (read(other.slice(at[c], 1)) for c in sorted(row["partners"][0].as_py()))


def _reach(far: np.ndarray, digits: int) -> np.ndarray:
    """Squares up to which a distance may round to ``far``."""
    return (far + 10.0**-digits + 1e-7) ** 2


def _best(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (row, dst, far) of each row, by distance, then dst."""
    row, dst, far = (np.concatenate([f[c] for f in found]) for c in range(3))
    order = np.lexsort((dst, far, row))
    row, dst, far = row[order], dst[order], far[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], dst[kept], far[kept]


def neighbours(vectors: DataFrame, k: int = 15, include_self: bool = True, block: int | None = None, digits: int = 9) -> DataFrame:
    """Exact ``k`` nearest rows of every row: (src, dst, d), by distance, then dst.

    ``vectors`` has id and v (array of double). Pairs of blocks that are too far apart for any of the ``k`` are left out by
    the triangle inequality; the others are compared by matrix products and keep their ``k`` best for each row. The last cut
    is a window. A row is its own neighbour at exactly 0. Distances are rounded to ``digits`` before they are ranked.
    """
    blocks, width = pack(vectors, k, block)

    def best(key, table):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, _, x, partners in _tile(table, width):
            # how far a row's partners may be, in squares, to round to one of its k best so far
            limit, kept, waiting = np.full(len(i), np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
            for j, _, y in partners:
                d = squares(x, y)
                at, itself = _places(i, j)
                d[itself, at] = 0.0 if include_self else np.inf
                if k <= len(j) and np.isinf(limit).any():
                    limit = np.minimum(limit, _reach(np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0)), digits))
                r, c = np.nonzero(d <= limit[:, None])
                exact = np.empty(len(r))
                for a in range(0, len(r), 8192):
                    exact[a : a + 8192] = np.round(np.sqrt(((x[r[a : a + 8192]] - y[c[a : a + 8192]]) ** 2).sum(1)), digits)
                same = i[r] == j[c]
                exact[same] = 0.0
                some = slice(None) if include_self else ~same
                kept.append((r[some], j[c][some], exact[some]))
                waiting += len(kept[-1][0])
                if waiting > 2 * k * len(i):
                    kept, waiting = [_best(kept, k)], 0
                    row, _, far = kept[0]
                    last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                    limit[row[last]] = np.minimum(limit[row[last]], _reach(far[last], digits))
            row, dst, far = _best(kept, k)
            out.append((i[row], dst, far))
        src, dst, far = (np.concatenate([o[c] for o in out]) for c in range(3))
        return pa.table({"src": src, "dst": dst, "d": far})

    found = _meetings(blocks, block_pairs(blocks), width).applyInArrow(best, "src long, dst long, d double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    # the table is read more than once by most callers, and the search is what costs
    out = materialise(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "neighbours")
    discard(blocks)
    return out


def label_sums(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """(id, cluster, other, n, s, q): number, sum and sum of squares of a row's distances to the rows of each cluster.

    ``vectors`` has id, cluster and v (array of double). Every pair counts, so none is left out; pairs of packed blocks are
    compared by matrix products and only sums leave. A row's distance to itself is left out.
    """
    blocks, width = pack(vectors, 0, block, "cluster")
    count = blocks.count()
    pairs = blocks.select("b", F.explode(F.sequence(F.lit(0), F.lit(max(0, count - 1)))).alias("c")) if count else blocks.select("b", F.col("b").alias("c"))

    def sums(key, table):
        others = np.unique(_numbers(table.filter(table["partners"].is_null())["groups"]))
        size, out = len(others), []
        for i, g, x, partners in _tile(table, width):
            n, s, q = np.zeros((len(i), size), np.int64), np.zeros((len(i), size)), np.zeros((len(i), size))
            for j, h, y in partners:
                square = np.maximum(squares(x, y), 0)
                at, itself = _places(i, j)
                square[itself, at] = 0.0
                column = np.searchsorted(others, h)
                member = np.zeros((len(h), size))
                member[np.arange(len(h)), column] = 1
                n += member.sum(0).astype(np.int64)
                n[itself, column[at]] -= 1
                q += square @ member
                s += np.sqrt(square, out=square) @ member
            out.append(pa.table({"id": np.repeat(i, size), "cluster": np.repeat(g, size), "other": np.tile(others, len(i)), "n": n.ravel(), "s": s.ravel(), "q": q.ravel()}))
        return pa.concat_tables(out)

    parts = _meetings(blocks, pairs, width).applyInArrow(sums, "id long, cluster long, other long, n long, s double, q double")
    return parts.groupBy("id", "cluster", "other").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
