"""How the sources of a language differ in their words: dense tiles of groups by terms, compared pair by pair.

A group is a (lang, source) that occurs. Terms are counted for each group; a language keeps the terms of at least
``least_docs`` of its documents. The kept terms of a language are dealt to blocks and its groups to tiles, so that a task
holds at most two tiles of ``GROUPS`` by about ``TERMS`` numbers, however many groups and terms there are. A task compares
all its groups by broadcasting and gives one partial sum for each pair; the sums of all blocks are added. Each group's
largest excesses over its language leave a block as a heap of ``top`` entries; the heaps are merged.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .common import discard, materialise
from .words import text_chunks

LEAST_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
ADDED = 5
#: Terms of a block (about) and groups of a tile.
TERMS, GROUPS = 512, 512
#: Numbers that a broadcast comparison holds at once.
AT_ONCE = 2_000_000
#: Distinct terms that a Python worker counts before it hands its partial counts on, and bytes that it takes apart at once.
FLUSH, SLICE = 200_000, 2_000_000

#: ASCII letters become lower case, other ASCII bytes separate terms, all other bytes belong to terms.
_FOLD = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _pieces(text: bytes):
    """The terms of ``text``, in lists of about SLICE bytes; a term is never cut."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Counts:
    """Occurrences and documents of terms for each group, handed on when ``FLUSH`` terms are held."""

    def __init__(self):
        self.held: dict = {}

    def add(self, group: tuple, text: bytes):
        """Count a whole text. A long one is gone through several times, each time for a part of its distinct terms."""
        counts, docs = self.held.setdefault(group, (Counter(), Counter()))
        if len(text) <= SLICE:
            words = text.translate(_FOLD).split()
            counts.update(words)
            docs.update(set(words))
            return
        shares = -(-len(text) // (4 * SLICE))
        for k in range(shares):
            own = Counter()
            for words in _pieces(text):
                own.update(words if shares == 1 else [w for w in words if hash(w) % shares == k])
            counts.update(own)
            docs.update(own.keys())
            if self.size() > FLUSH:
                yield from self.flush()
                counts, docs = self.held.setdefault(group, (Counter(), Counter()))

    def size(self) -> int:
        return sum(len(c) for c, _ in self.held.values())

    def flush(self):
        for (lang, source), (counts, docs) in self.held.items():
            terms = [None, *counts]
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        self.held = {}


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents that hold it, as a table.

    A group also has a row with a null term, so groups without terms are there. Rows are documents; repeated rows count
    each time. Workers add up before anything is shuffled.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def count(batches):
        counts = _Counts()
        for batch in batches:
            lang, source = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, last, texts in text_chunks(batch.column(0).cast(pa.binary())):
                for i, text in zip(range(first, last), texts):
                    yield from counts.add((lang[i], source[i]), text)
                if counts.size() > FLUSH:
                    yield from counts.flush()
        yield from counts.flush()

    partial = map_arrow(rows, count, "lang string, source string, term string, n long, docs long")
    return materialise(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + ADDED) / whole), exact in 64 bits while ``whole`` is below 9e15: three digits at a time."""
    rest, out = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of every row of ``p`` with every row of ``q``, a few rows at a time."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, AT_ONCE // max(1, q.size))
    for i in range(0, len(p), step):
        out[i : i + step] = np.abs(p[i : i + step, None, :] - q[None, :, :]).sum(2)
    return out


def _compare(top: int):
    """The task of one block of terms and one pair of tiles."""

    def run(key, table):
        lang, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        is_group = pc.is_null(table["term"])
        groups, rows = table.filter(is_group), table.filter(pc.invert(is_group))
        kept, n_lang, in_block = (groups[c][0].as_py() for c in ("n_terms", "n_lang", "n_block"))
        coded = rows["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        terms = [t.encode() for t in coded.dictionary.to_pylist()] if len(rows) else []
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        column = place[coded.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
        row, tile, n = (rows[c].to_numpy().astype(np.int64) for c in ("idx", "tile", "n"))
        total = np.zeros(len(terms), np.int64)
        total[column] = rows["total"].to_numpy()

        def dense(t):
            """Ids, counts by term, shares by term and share of an absent term of a tile's groups."""
            own = groups.filter(pc.equal(groups["tile"], t))
            ids, whole = own["idx"].to_numpy().astype(np.int64), own["n_group"].to_numpy().astype(np.int64) + ADDED * kept
            by = np.argsort(ids)
            ids, whole = ids[by], np.maximum(whole[by], 1)
            counts = np.zeros((len(ids), len(terms)), np.int64)
            mine = tile == t
            counts[np.searchsorted(ids, row[mine]), column[mine]] = n[mine]
            return ids, counts, shares(counts, whole[:, None]), shares(np.zeros(len(ids), np.int64), whole)

        ids, counts, p, none = dense(left)
        other = (ids, counts, p, none) if left == right else dense(right)
        sums = pair_sums(p, other[2]) + (in_block - len(terms)) * np.abs(none[:, None] - other[3][None, :])
        i, j = np.triu_indices(len(ids), 1) if left == right else np.indices(sums.shape).reshape(2, -1)
        a, b, value, term = [ids[i]], [other[0][j]], [sums[i, j]], [None] * len(i)
        if left == right:
            excess = p - shares(total, np.int64(max(n_lang + ADDED * kept, 1)))[None, :]
            excess[counts == 0] = 0
            for k, e in zip(ids.tolist(), excess):
                some = np.flatnonzero(e > 0)
                best = heapq.nsmallest(top, zip((-e[some]).tolist(), some.tolist()))
                a.append(np.full(len(best), k))
                b.append(np.full(len(best), -1))
                value.append(np.array([-v for v, _ in best], np.int64))
                term.extend(terms[order[c]].decode() for _, c in best)
        a, b, value = (np.concatenate(x).astype(np.int64) for x in (a, b, value))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "term": pa.array(term, pa.string()), "value": value})

    return run


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    With a group's share of a term p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)) over its language's V kept terms (N: the
    group's occurrences of them): part ``pair`` has each other source of the language with the sum of |p - q| over the
    kept terms; part ``term`` the ``top`` kept terms which the group holds and which its share exceeds its language's by
    most. Ranks begin at 1 for each group and part, by falling value, then by the item's bytes. All in integers.

    Null text, lang and source count as ''. A group without terms takes part with counts of 0; a language without kept
    terms has pairs of 0 and no terms. Repeated rows and ids are documents of their own. A text of any length is taken apart in slices, and a
    long one goes through its distinct terms by shares. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    counts = term_counts(docs)
    same = Window.partitionBy("lang", "term")
    kept = counts.filter("term IS NOT NULL").withColumns({"docs": F.sum("docs").over(same), "total": F.sum("n").over(same), "first": (F.row_number().over(same.orderBy("source")) == 1).cast("long")})
    kept = materialise(kept.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("first").alias("n_terms"), F.sum("n").alias("n_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    of_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = counts.filter("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *map(zero, ("n_group", "n_terms", "n_lang")), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("idx"), F.count("*").over(of_lang).alias("n_groups"))
    groups = groups.withColumns({"tile": F.expr(f"cast(idx div {GROUPS} as int)"), "tiles": F.expr(f"cast((n_groups - 1) div {GROUPS} + 1 as int)"), "blocks": F.expr(f"cast(greatest((n_terms - 1) div {TERMS} + 1, 1) as int)")})
    groups = materialise(groups, "groups")
    # both kinds of rows go to every pair of tiles that their own tile is in
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("left"), F.greatest("tile", t).alias("right")))).alias("at")
    columns = ["lang", "block", "at.left", "at.right", "tile", "idx", "n_group", "n_terms", "n_lang", "n_block", "term", "n", "total"]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    block = F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int").alias("block")
    placed = kept.join(groups.select("lang", "source", "idx", "tile", "tiles", "blocks"), ["lang", "source"])
    in_block = placed.filter("first = 1").groupBy("lang", block).agg(F.count("*").alias("n_block"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(in_block, ["lang", "block"], "left")
    heads = heads.select("*", meets).withColumn("n_block", zero("n_block")).select(*columns[:10], *none("string", "term"), *none("long", "n", "total"))
    rows = placed.select("lang", block, "tile", "idx", "term", "n", "total", meets).select(*columns[:6], *none("long", *columns[6:10]), *columns[10:])
    tiles = materialise(heads.unionByName(rows).groupBy("lang", "block", "left", "right").applyInArrow(_compare(top), "lang string, a long, b long, term string, value long"), "tiles")
    discard(counts)
    discard(kept)
    names = groups.select("lang", F.col("idx").cast("long").alias("a"), "source")
    pairs = tiles.filter("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(names, ["lang", "a"]).join(names.toDF("lang", "b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = tiles.filter("term IS NOT NULL").join(names, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
