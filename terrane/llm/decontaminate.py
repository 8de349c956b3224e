"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are lower-cased and stripped of marks. Each of a few fixed masks covers ``SPAN`` neighbouring words and hashes those
it marks 1, ignoring the others, so a hit survives changed words. Around a hit of training text on a benchmark item
both are compared word by word at that offset: the best window of the item must agree in ``SHARE`` of its words.

Items shorter than a window are cut into one piece more than words may change, so one piece is always unchanged; each piece's
first words (``PIECE`` at most) are its seed, and no such item is missed. Items of fewer than ``SPAN`` words must agree in full. Of
the 53,130 ways to change 5 of 25 words, the masks miss 25 (0.05 %) in a window that stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, without

#: Fixed masks over ten words: six words count.
MASKS = ("1101100101", "1010011011", "1110010011")
SPAN = 10
#: Words of a piece of a short item that count.
PIECE = 3
#: Words of the window that is verified (the whole item where it is shorter), and the share that must agree.
WINDOW = 25
SHARE = 0.8
#: Rows of seeds (hash, item's key, size, position: 24 bytes) and words of items (8 bytes) that may be broadcast; beyond that joins shuffle.
BROADCAST_ROWS = 2_000_000
#: Copies of an item, one for each part of its hits, where items are too large to broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (any script); a null text has none."""
    cleaned = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(cleaned, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, columns: list[str], h: str, pieces: list[int] = ()) -> DataFrame:
    """``columns``, position, and one hash for each mask at every place where ``SPAN`` words stand (array ``seed``).

    ``pieces`` are numbers of neighbouring words that are hashed besides, at every place; where too few words stand, a hash is NULL.
    """
    shifts = sorted({i for m in MASKS for i, c in enumerate(m) if c == "1"} | {i for p in pieces for i in range(p)})
    n = F.greatest(F.size(h) - (SPAN - 1), F.lit(0))
    length = lambda i: F.greatest(F.size(h) - i, F.lit(0)) if pieces else n
    zipped = F.arrays_zip(*[F.slice(F.col(h), F.lit(i + 1), length(i)).alias(f"w{i}") for i in shifts])
    spread = df.select(*columns, F.posexplode(zipped).alias("position", "w"))
    spread = spread.select(*columns, "position", *[F.col(f"w.w{i}") for i in shifts])
    masks = [F.xxhash64(F.lit(k), *[F.col(f"w{i}") for i, c in enumerate(m) if c == "1"]) for k, m in enumerate(MASKS)]
    if pieces:
        masks = [F.when(F.col(f"w{SPAN - 1}").isNotNull(), m) for m in masks]
    runs = [F.when(F.col(f"w{p - 1}").isNotNull(), F.xxhash64(F.lit(-p), *[F.col(f"w{i}") for i in range(p)])) for p in pieces]
    return spread.select(*columns, "position", F.array(*masks, *runs).alias("seed"))


def needed(size: Column, share: float) -> Column:
    """Words of a window of ``size`` words that must agree: all of fewer than ``SPAN``, else ``share`` of them."""
    return F.when(size < SPAN, size).otherwise(F.ceil(size * share)).cast("int")


def piece_seeds(item: DataFrame, share: float) -> DataFrame:
    """(item_key, n, item_position, seed, piece) of short items: one piece more than words may change."""
    n = F.size("item")
    item = item.withColumn("changes", n - needed(n, share)).withColumn("step", F.floor(n / (F.col("changes") + 1)).cast("int"))
    item = item.withColumn("piece", F.least(F.col("step"), F.lit(PIECE)))
    item = item.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("changes")))).withColumn("item_position", F.col("k") * F.col("step"))
    seed = F.coalesce(*[F.when(F.col("piece") == p, F.xxhash64(F.lit(-p), *[F.get("item", F.col("item_position") + i) for i in range(p)])) for p in range(1, PIECE + 1)])
    return item.select("item_key", "n", "item_position", seed.alias("seed"), "piece")


def _key(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(F.lit(k), text).alias(f"t{k}") for k in (0, 1)]


def verified(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each offset at which a text holds a passage of an item: doc_id, t0, t1 (hashes of the text), item_id, shift, size, agreed.

    Texts and items are told apart by what they hold, so rows that repeat an id, or have none, are verified one by one and
    equal rows once.
    """
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashes(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    items = materialise(item.select("item_id", "item", F.size("item").alias("n"), F.xxhash64("item_id", "item").alias("item_key")), "benchmark-items")
    short = piece_seeds(items.filter(F.col("n") < window), share)
    index = seeds(items.filter(F.col("n") >= window), ["item_key", "n"], "item").select("item_key", "n", F.col("position").alias("item_position"), F.explode("seed").alias("seed"), F.lit(None).cast("int").alias("piece"))
    index = materialise(index.unionByName(short).distinct(), "benchmark-seeds")
    pieces = sorted(r["piece"] for r in index.select("piece").filter("piece IS NOT NULL").distinct().collect())
    rows, index = index.count(), index.drop("piece")
    text = F.col("text").cast("string")
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(text), hashes(text).alias("h"))
    shift = F.col("position") - F.col("item_position")
    # words of the text that lie beside the item's, from the shift on
    low, high = F.greatest(F.lit(0), -F.col("shift")), lambda size: F.least(F.col("n"), size - F.col("shift"))
    enough = F.least(F.lit(window), F.col("n"))
    if rows <= broadcast_rows:
        # no lambda between the hashes and the aggregate, so that they stay in one generated stage and copy no document
        hit = seeds(doc, ["doc_id", "t0", "t1", "h"], "h", pieces).withColumn("seed", F.explode("seed")).join(F.broadcast(index), "seed").withColumn("shift", shift)
        hit = hit.filter(high(F.size("h")) - low >= enough)
    else:
        # the seeds are shuffled without their texts; the texts are read again for the hits
        sized = docs.select(*_key(text), hashes(text).alias("h")).withColumn("words", F.size("h"))
        met = seeds(sized, ["t0", "t1", "words"], "h", pieces).withColumn("seed", F.explode("seed")).filter("seed IS NOT NULL").join(index, "seed").withColumn("shift", shift)
        met = materialise(met.filter(high(F.col("words")) - low >= enough).select("t0", "t1", "item_key", "n", "shift").distinct(), "benchmark-hits")
        hit = doc.join(broadcast_if_small(met, met.count(), broadcast_rows), ["t0", "t1"])
    hit = hit.select("doc_id", "t0", "t1", "item_key", "n", "shift", F.slice("h", F.col("shift") + low + 1, high(F.size("h")) - low).alias("beside"))
    offset = hit.groupBy("doc_id", "t0", "t1", "item_key", "n", "shift").agg(F.first("beside").alias("beside"))
    known = items.select("item_key", "item_id", "item")
    if (items.agg(F.sum("n")).first()[0] or 0) <= broadcast_rows:
        offset = offset.join(F.broadcast(known), "item_key")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        offset = offset.withColumn("salt", F.pmod(F.col("t0"), F.lit(SALTS)).cast("int")).join(known, ["item_key", "salt"])
    offset = offset.withColumn("size", enough)
    offset = offset.withColumn("same", F.zip_with(F.slice("item", low + 1, F.size("beside")), "beside", lambda x, y: (x == y).cast("int")))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("size") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("size")), F.lit(0), lambda x, y: x + y))
    return offset.select("doc_id", "t0", "t1", "item_id", "shift", "size", F.array_max(sums).alias("agreed")).filter(F.col("agreed") >= needed(F.col("size"), share))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each (doc_id, item_id) where a document holds a passage of a benchmark item.

    Columns: doc_id, item_id, agreed (words of the best window that agree), window (its words), position (the document's word
    that meets the item's first, at the smallest offset that is verified; negative if the document begins later). A hit
    gives an offset of the item in the document; the windows of min(``window``, item) words of the item at that offset
    are compared; an item of fewer than ``SPAN`` words must stand there unchanged. Null and empty texts, and overlaps of fewer
    words than the window, match nothing; very long texts are read whole. Rows with equal ids are verified one by one and
    reported together, and so are rows with a null id; the order of rows does not matter; other columns are ignored; no
    documents or no items give no rows.

    Documents are scanned once and never shuffled while the benchmark's seeds are few enough to broadcast: a hit leaves with
    the words beside the item, and hits of one offset are combined before they are. Beyond that, seeds are joined by a
    shuffle in one pass, whatever the benchmark's size.
    """
    offset = verified(docs, benchmark, window, share, broadcast_rows)
    return offset.groupBy("doc_id", "item_id").agg(F.max("agreed").cast("long").alias("agreed"), F.max("size").cast("long").alias("window"), F.min("shift").cast("long").alias("position"))


def remove(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay, whatever they are called.

    All rows of an id go if one of them leaks; a row with a null id goes if its own text leaks.
    """
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat_ws("/", *_key(F.col("text").cast("string"))))
    gone = verified(docs, benchmark, **how).select(F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", "t0", "t1")))
    return without(docs, gone, key)
