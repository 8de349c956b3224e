"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, then their values' hashes are counted by distinct repositories and owners over the
whole corpus: a value held by many owners is a copied example, one held by few looks live. Three base kinds (assign,
access, hex) are always reported. The method adds kind "live": other random-looking tokens whose value belongs to at most
``max_owners`` owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialise

#: The base patterns, by kind.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 16 or more is a run's whole match: the runs that fail are left out by the pattern itself.
HEX = r"[0-9a-f]{16,}"
#: What the method adds: runs of token characters, 24 at least, with upper case, lower case and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "live")
#: A value that more owners (or repositories) than this hold is a copied example.
MAX_OWNERS = 2
#: Copied values (hashes of 8 bytes), or hashes and offsets of texts, that may be broadcast; beyond that joins shuffle.
BROADCAST_ROWS = 500_000


#: Items that are gone through between two looks at what was gathered before: gathering n items copies about n times this.
CHUNK = 256


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out one time: a lambda's argument is a value, an expression is worked out wherever it stands."""
    return F.transform(F.array(value), use)[0]


def gathered(items: Column, at: Column, none: Column, step) -> Column:
    """What ``step(state, item)`` gathers from an array, where a state is (at, found) and begins with ``at`` and ``none``.

    ``found`` is an array or a text that grows. Items are taken in chunks, and a chunk's own findings are added to all
    findings when it ends, so that a text with a great many matches is not copied again for each of them.
    """
    whole = F.struct(at.alias("at"), none.alias("found"))

    def chunk(state: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("found")), step)
        return once(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], s["found"]).alias("found")))

    def every(items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))
        return F.aggregate(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK)), whole, chunk)

    return once(items, every)


def matches(text: Column, pattern: str, kind: int, keeps) -> Column:
    """Array of (start, end, kind, value) of the leftmost non-overlapping matches that ``keeps(match)`` admits.

    Offsets are code points: what lies between matches and the matches themselves, alternately, add up to the text.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")

    def step(state: Column, item: Column) -> Column:
        first = state["at"] + F.length(item["gap"])
        last = first + F.length(item["hit"])
        one = F.array(F.struct(first.alias("start"), last.alias("end"), F.lit(kind).alias("kind"), item["hit"].alias("value")))
        return F.struct(last.alias("at"), F.when(keeps(item["hit"]), F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.exists(hits, keeps), gathered(pairs, F.lit(0), none, step)["found"]).otherwise(none)


def candidates(text: Column) -> Column:
    """Base matches of whole texts and further token-like runs (kind 3), by start, then kind. A null text is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    longest = lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 12
    mixed = lambda h: h.rlike("[0-9]") & h.rlike("[A-Z]") & h.rlike("[a-z]")
    found = F.concat(
        matches(text, ASSIGN, 0, longest),
        matches(text, ACCESS, 1, lambda h: F.length(h) >= 18),
        matches(text, HEX, 2, lambda h: F.length(h) >= 16),
        matches(text, TOKEN, 3, mixed),
    )
    return F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def value_of(found: Column) -> Column:
    """The credential itself: what an assignment assigns, else the whole match."""
    return F.when(found["kind"] == 0, F.regexp_extract(found["value"], ASSIGN, 1)).otherwise(found["value"])


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners) from rows (value_hash, repository, owner).

    Rows are reduced to distinct triples before values are counted, so a value that fills a third of the corpus is
    pre-aggregated where it is read. Null repositories and owners count as one each.
    """
    named = found.select("value_hash", F.coalesce(F.col("repository"), F.lit("")).alias("repository"), F.coalesce(F.col("owner"), F.lit("")).alias("owner"))
    pairs = named.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("uses"))
    return pairs.groupBy("value_hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def copied(each: DataFrame, max_owners: int) -> DataFrame:
    """(value_hash) of the copied examples: values that more than ``max_owners`` owners or repositories hold."""
    return materialise(ownership(each).filter((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_owners)).select("value_hash"), "secrets-copied")


def joined_spans(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "source", max_owners: int = MAX_OWNERS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and the named columns).

    Columns: doc_id, n_assign, n_access, n_hex, n_live, n_owned (base matches whose value at most ``max_owners`` owners
    and repositories hold), n_copied (the other base matches), base_sha256, spans, and found: an array of (start, end,
    kind, owned). Null and empty texts have none. Rows may repeat; an empty table gives no rows.

    The table of candidates is written once, as many rows and small: texts are matched one time, whole, however long. Only
    values held by many owners are joined back, so a value that is copied everywhere is one row of the small side.
    """
    row = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), candidates(F.col("text")).alias("found")).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = row.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f"))
    each = each.select("row", "owner", "repository", "f.start", "f.end", "f.kind", F.xxhash64(value_of(F.col("f"))).alias("value_hash"))
    many = copied(each, max_owners)
    each = each.join(broadcast_if_small(many.withColumn("owned", F.lit(False)), many.count(), broadcast_rows), "value_hash", "left").withColumn("owned", F.coalesce("owned", F.lit(True)))
    judged = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owned"))).alias("judged"))
    out = row.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,end:int,owned:boolean>>")))
    base = F.filter("judged", lambda x: x["kind"] < 3)
    final = F.filter("judged", lambda x: (x["kind"] < 3) | x["owned"])

    def count(test) -> Column:
        return F.size(F.filter("judged", test)).cast("long")

    return out.select(
        "doc_id",
        count(lambda x: x["kind"] == 0).alias("n_assign"),
        count(lambda x: x["kind"] == 1).alias("n_access"),
        count(lambda x: x["kind"] == 2).alias("n_hex"),
        count(lambda x: (x["kind"] == 3) & x["owned"]).alias("n_live"),
        count(lambda x: (x["kind"] < 3) & x["owned"]).alias("n_owned"),
        count(lambda x: (x["kind"] < 3) & ~x["owned"]).alias("n_copied"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(final).alias("spans"),
        F.transform(final, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["owned"].alias("owned"))).alias("found"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "source", mask: str = "[SECRET]", max_owners: int = MAX_OWNERS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the owned (live-looking) matches replaced by ``mask``; copied examples and other columns stay.

    Overlapping matches are replaced together. All rows stay, and so do all columns, whatever they are called; null and empty
    texts stay as they are; very long texts are masked whole; an empty table gives no rows. Rows are told apart by hashes of
    their text, so equal texts are treated alike, and texts are never shuffled while the texts with owned matches are few
    enough to broadcast their offsets.
    """
    text = F.col("text").cast("string")
    key = [F.xxhash64(F.lit(k), text) for k in (0, 1)]
    found = docs.select(key[0].alias("t0"), key[1].alias("t1"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), candidates(text).alias("found"))
    found = materialise(found.filter(F.size("found") > 0), "secrets-redact")
    each = found.select("t0", "t1", "owner", "repository", F.explode("found").alias("f"))
    each = each.select("t0", "t1", "owner", "repository", "f.start", "f.end", F.xxhash64(value_of(F.col("f"))).alias("value_hash"))
    many = copied(each, max_owners)
    each = each.join(broadcast_if_small(many, many.count(), broadcast_rows), "value_hash", "left_anti")
    k0, k1, cuts = (fresh(docs, x) for x in ("t0", "t1", "cuts"))
    held = each.groupBy(F.col("t0").alias(k0), F.col("t1").alias(k1)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts))
    held = materialise(held, "secrets-cuts")
    size = held.agg(F.sum(F.size(cuts) + 2)).first()[0] or 0
    out = docs.join(broadcast_if_small(held, size, broadcast_rows), (key[0] == F.col(k0)) & (key[1] == F.col(k1)), "left")

    def step(s: Column, c: Column) -> Column:
        begins = c["start"] >= s["at"]
        piece = F.concat(s["found"], text.substr(s["at"] + 1, c["start"] - s["at"]), F.lit(mask))
        return F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(begins, piece).otherwise(s["found"]).alias("found"))

    done = gathered(F.col(cuts), F.lit(0), F.lit(""), step)
    masked = F.concat(done["found"], text.substr(done["at"] + 1, F.length(text)))
    new = F.when(F.col(cuts).isNull(), text).otherwise(masked)
    return out.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
