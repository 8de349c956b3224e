"""Communities of weighted graphs by rounds over tables.

Levels of local moves, refinement and aggregation, for all resolutions at once. The links of a level stay where they are, dealt
by node and held by the executors, also as lists of some 100,000 links. A round sends the labels to the lists, adds up within a node's links in
arrays and writes one table of nodes, so only tables of nodes travel; no task holds a graph, and only numbers for each resolution come to the driver.
Weights are whole numbers, so sums are exact and labels are the same for any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..observed import Tally
from ..scratch import discard, materialise
from ..shipping import map_arrow
from .ranks import numbered

#: Bits of the sum of all weights: sums are exact as integers and as doubles.
BITS = 52
#: Gains of quality: of a pair of rounds, for a level to go on; of a level, for another one; of a pair of last moves.
GAIN, LEVEL_GAIN, LAST_GAIN = 4e-2, 1e-3, 1e-4
#: Most nodes of all runs whose labels are sent to all tasks, with more both sides are shuffled; and links of a task and of a list.
SENT, TASK_LINKS, LIST_LINKS = 1_000_000, 100_000, 300_000


class _Graph:
    """One level: ``links`` (run, i, j, x) both ways and loops once, ``nodes`` (run, node, k), and what all levels share.

    Without ``run`` the links are those of every run. Rounds of moves need a loop, of any weight, for each node.
    """

    def __init__(self, links: DataFrame, whole: float, gammas: list[float], seed: int, tables: list, sent: int = SENT):
        self.whole, self.gammas, self.seed, self.tables, self.held, self.sent = whole, gammas, seed, tables, [], sent
        self.run = ["run"] if "run" in links.columns else []
        tasks, cores = max(1, -(-links.count() // TASK_LINKS)), links.sparkSession.sparkContext.defaultParallelism
        # full waves of tasks where there is more than one
        waves = lambda n: n if n < cores else -(-n // cores) * cores
        self.links, self.lists, self.packs = self.hold(links.repartition(waves(tasks), "i")), None, waves(max(min(tasks, cores), -(-tasks * TASK_LINKS // LIST_LINKS)))
        # a loop counts for both of its ends
        loop = F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(0)
        nodes = self.links.groupBy(*self.run, F.col("i").alias("node")).agg(F.sum(F.col("x") + loop).alias("k"), F.sum(2 * loop).alias("loop"))
        nodes = nodes if self.run else nodes.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(len(gammas))])))
        seen = Tally()
        found = self.keep(seen.on(nodes, k=F.sum(F.when(F.col("run") == 0, F.col("k"))), **{f"loop{r}": F.sum(F.when(F.col("run") == r, F.col("loop"))) for r in range(len(gammas))}), "strengths")
        self.nodes, self.n, self.strength = found.select("run", "node", "k"), seen.get(), seen.get("k")
        self.loops = [seen.get(f"loop{r}") for r in range(len(gammas))]

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialise(df, f"communities-{label}"))
        return self.tables[-1]

    def hold(self, df: DataFrame) -> DataFrame:
        """``df`` held by the executors, on disk where memory ends, until ``release``."""
        self.held.append(df.persist())
        return self.held[-1]

    def listed(self) -> DataFrame:
        """(at, links): the links in as many lists as there are tasks of a round, all links of a node in one list; held too."""
        if self.lists is None:
            row = F.struct(*[F.col(c) for c in self.links.columns])
            lists = self.links.groupBy(F.pmod(F.xxhash64("i"), F.lit(self.packs)).alias("at")).agg(F.collect_list(row).alias("links"))
            self.lists = self.hold(lists.select("at", *[F.col(f"links.{c}").alias(c) for c in self.links.columns]).repartition(self.packs))
        return self.lists

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def small(self, df: DataFrame) -> DataFrame:
        """A table of no more rows than there are nodes, sent to all tasks if those are few."""
        return F.broadcast(df) if self.n <= self.sent else df

    def expected(self, k: Column, total: Column) -> Column:
        """The weight that chance would put between strengths ``k`` and ``total``, times the resolution."""
        gamma = F.element_at(F.array(*map(F.lit, self.gammas)), F.col("run") + 1)
        return gamma * k * total / (2 * self.whole)

    def inner(self, labels: DataFrame) -> DataFrame:
        """(run, i, j, x): links between different nodes of one label."""
        a, b = labels.select("run", F.col("node").alias("i"), F.col("label").alias("a")), labels.select("run", F.col("node").alias("j"), F.col("label").alias("b"))
        links = self.links.filter("i <> j").join(self.small(b), [*self.run, "j"]).join(self.small(a), ["run", "i"])
        return self.hold(links.filter("a = b").select("run", "i", "j", "x"))

    def turn(self, number: int, node: str = "node") -> Column:
        """Half of the nodes, the other half in the other round of a pair. Two ways to halve take turns, so that plans repeat and compiled code is used again."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(number // 2 % 2), F.col(node)), F.lit(2)) == number % 2


def communities(edges: DataFrame, resolutions: list[float], seed: int = 123, refine: bool = True, sent: int = SENT) -> DataFrame:
    """(run, resolution, node, label) of symmetric edges (src, dst, w), a run for each resolution.

    Labels count from 0 by falling size, then least node, and every community is connected. With ``refine`` a community is
    only built from parts that are well connected inside it; without, levels are built from whole communities. Weights are those of
    ``modularity``: each unordered pair has twice its weight, a loop once. Edges with a null are ignored; no edges give no rows.
    Labels of up to ``sent`` nodes, counted over all runs, are sent to all tasks; those of more are shuffled.
    """
    spark, tables = edges.sparkSession, []
    kind = dict(edges.dtypes)["src"]
    if kind != "bigint":
        # rounds work on whole numbers, in the order of the names
        names = materialise(numbered(edges.select(F.explode(F.array("src", "dst")).alias("name")).filter("name IS NOT NULL"), ["name"], "__id"), "communities-names")
        src, dst = names.select(F.col("name").alias("src"), F.col("__id").alias("__src")), names.select(F.col("name").alias("dst"), F.col("__id").alias("__dst"))
        ends = edges.join(src, "src").join(dst, "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), "w")
        out = communities(ends, resolutions, seed, refine, sent)
        return out.withColumnRenamed("node", "__id").join(names, "__id").select("run", "resolution", F.col("name").alias("node"), "label")
    gammas = [float(r) for r in resolutions]
    half = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.when(F.col("src") == F.col("dst"), 1.0).otherwise(2.0) * F.col("w")).alias("w")).filter("i IS NOT NULL AND j IS NOT NULL AND w >= 0 AND i <= j")
    whole = half.agg(F.sum("w")).first()[0]
    if whole is None:
        return spark.createDataFrame([], f"run int, resolution double, node {kind}, label long")
    scale = 2.0 ** (BITS - math.ceil(math.log2(whole))) if whole > 0 else 1.0
    x = half.select("i", "j", F.round(F.col("w") * scale).cast("long").alias("x"))
    ends = x.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0).cast("long").alias("x"))
    links = materialise(x.union(x.filter("i <> j").select("j", "i", "x")).union(ends).groupBy("i", "j").agg(F.sum("x").alias("x")), "communities-links")
    tables.append(links)
    graph = _Graph(links, 1.0, gammas, seed, tables, sent)
    graph.whole = max(1.0, graph.strength / 2)
    first = graph
    member = graph.nodes.select("run", "node", F.col("node").alias("top"))
    labels = graph.nodes.withColumn("label", F.col("node"))
    before: dict[int, float] = {}
    while True:
        labels, quality = _moves(graph, labels)
        # a level begins where the last one ended, so one that gains next to nothing is the last
        if labels.select("run", "label").distinct().count() == graph.n or (before and all(quality[r] <= before[r] + LEVEL_GAIN for r in quality)):
            break
        before = quality
        part = labels.select("run", "node", "label", F.col("label").alias("part"))
        if refine:
            finer = _refined(graph, labels)
            # where nothing can be merged well the communities themselves go on
            part = finer if finer.select("run", "part").distinct().count() < graph.n else part
        member = graph.keep(member.join(part.select("run", F.col("node").alias("top"), "part"), ["run", "top"]).select("run", "node", F.col("part").alias("top")), "members")
        a, b = part.select("run", F.col("node").alias("i"), F.col("part").alias("a")), part.select("run", F.col("node").alias("j"), F.col("part").alias("b"))
        weight = F.when((F.col("a") == F.col("b")) & (F.col("i") != F.col("j")), F.col("x") / 2).otherwise(F.col("x"))
        # both directions of an inner pair add up to an even number
        joined = graph.links.join(graph.small(b), [*graph.run, "j"]).join(graph.small(a), ["run", "i"]).groupBy("run", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum(weight).cast("long").alias("x"))
        start = part.groupBy("run", "part").agg(F.min("label").alias("label"))
        links = graph.keep(joined, "links")
        if graph is not first:
            graph.release()
        graph = _Graph(links, graph.whole, gammas, seed, tables, sent)
        labels = graph.keep(graph.nodes.join(start.withColumnRenamed("part", "node"), ["run", "node"]), "labels")
    own = member.join(labels.select("run", F.col("node").alias("top"), "label"), ["run", "top"]).select("run", "node", "label")
    # single nodes move once more, now between whole communities
    own, _ = _moves(first, graph.keep(first.nodes.join(own, ["run", "node"]), "labels"), LAST_GAIN)
    own = _connected(first, own)
    sizes = own.groupBy("run", "label").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    rank = sizes.select("run", "label", (F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), "least")) - 1).cast("long").alias("rank"))
    resolution = F.element_at(F.array(*map(F.lit, gammas)), F.col("run") + 1).alias("resolution")
    out = materialise(own.join(rank, ["run", "label"]).select("run", resolution, "node", F.col("rank").alias("label")), "communities")
    first.release()
    graph.release()
    for t in tables:
        discard(t)
    return out


def _moves(graph: _Graph, labels: DataFrame, least: float = GAIN) -> tuple[DataFrame, dict[int, float]]:
    """Labels (run, node, k, label) and the quality of each run after moves of single nodes to the neighbouring community of largest gain.

    In a round half of the nodes choose at once. Two nodes may choose well alone and badly together, so a pair of rounds
    counts only if it raises the run's quality; otherwise the run keeps its labels. A run is done when a pair gains under ``least``.
    A round also sees the quality of the labels that it begins with, so the round after a pair is the one that judges it.
    """
    trial, number, best, found = labels, 0, {}, {}
    while True:
        step, now = _turn(graph, trial, number)
        if now:
            better = [r for r in now if r not in best or now[r] > best[r]]
            running = [r for r in better if r not in best or now[r] > best[r] + least]
            best |= {r: now[r] for r in better}
            found |= dict.fromkeys(better, step)
            if not running:
                break
            step = step.filter(F.col("run").isin(running))
        trial, number = step.select("run", "node", "k", F.col("to").alias("label")), number + 1
    for r, df in found.items():
        own = df.filter(F.col("run") == r).select("run", "node", "k", "label")
        out = own if r == min(found) else out.union(own)
    return graph.keep(out, "labels"), best


def _turn(graph: _Graph, labels: DataFrame, number: int) -> tuple[DataFrame, dict[int, float]]:
    """(run, node, k, label, to): the label that each node whose turn it is would rather have, and the quality of each run before.

    In the second round of a pair nothing is judged, so only the links of nodes whose turn it is are read.
    """
    judged = number % 2 == 0
    sizes = labels.groupBy("run", "label").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    sized = labels.join(graph.small(sizes), ["run", "label"])
    best = _chosen_in_lists(graph, sized, number) if graph.n <= graph.sent else _chosen(graph, sized, number)
    columns = ["run", "node", "k", "label", "to"]
    if not judged:
        rest = labels.filter(~graph.turn(number)).select("run", "node", "k", "label", F.col("label").alias("to"))
        return graph.keep(best.select(*columns).union(rest), "turn"), {}
    seen = Tally()
    runs = range(len(graph.gammas))
    of = lambda r, c: F.sum(F.when(F.col("run") == r, c))
    chance = graph.expected(F.col("k").cast("double"), F.col("total").cast("double"))
    counts = {f"{name}{r}": of(r, c) for r in runs for name, c in (("nodes", 1), ("inside", F.col("inside")), ("chance", chance))}
    step = graph.keep(seen.on(best, **counts).select(*columns), "turn")
    return step, {r: ((seen.get(f"inside{r}") + graph.loops[r]) / 2 - seen.get(f"chance{r}") / 2) / graph.whole for r in runs if seen.get(f"nodes{r}")}


def _chosen(graph: _Graph, sized: DataFrame, number: int) -> DataFrame:
    """(run, node, k, label, to, inside, total): what nodes would rather have, ``inside`` and ``total`` of their own label; labels are shuffled to the links."""
    theirs = sized.select("run", F.col("node").alias("j"), F.col("label").alias("to"), "total", "n")
    mine = sized.select("run", F.col("node").alias("i"), "k", F.col("label").alias("own"), F.col("n").alias("own_n"))
    x = F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("x"))
    near = (graph.links if number % 2 == 0 else graph.links.filter(graph.turn(number, "i"))).join(theirs, [*graph.run, "j"]).groupBy("run", "i", "to").agg(F.sum(x).alias("x"), F.max("total").alias("total"), F.max("n").alias("n"))
    here, chooses = F.col("to") == F.col("own"), graph.turn(number, "i")
    gain = F.col("x") - graph.expected(F.col("k").cast("double"), F.col("total") - F.when(here, F.col("k")).otherwise(0))
    # two single nodes would only change places: the one with the larger label goes to the other
    swap = (F.col("own_n") == 1) & (F.col("n") == 1) & (F.col("to") > F.col("own"))
    options = near.join(mine, ["run", "i"]).filter(here | (chooses & ~swap)).withColumn("gain", gain)
    stay = lambda c: F.max(F.when(here, F.col(c)))
    best = options.groupBy("run", F.col("i").alias("node")).agg(F.min_by("to", F.struct(-F.col("gain"), "to")).alias("to"), F.max("gain").alias("gain"), stay("gain").alias("stay"), F.max("own").alias("label"), F.max("k").alias("k"), stay("x").alias("inside"), stay("total").alias("total"))
    to = F.when(F.col("gain") > F.col("stay") + graph.whole * 1e-12, F.col("to")).otherwise(F.col("label")).alias("to")
    return best.select("run", "node", "k", "label", to, "inside", "total")


def _chosen_in_lists(graph: _Graph, sized: DataFrame, number: int) -> DataFrame:
    """As ``_chosen``: labels are one row of arrays, in the order of runs and nodes, that is sent to all lists of links."""
    row = F.struct("run", "node", "k", "label", "total", (F.col("n") == 1).alias("single"), graph.turn(number).alias("chooses"))
    names = ["run", "node", "k", "label", "total", "single", "chooses"]
    state = sized.agg(F.sort_array(F.collect_list(row)).alias("state")).select(*[F.col(f"state.{c}").alias(f"of_{c}") for c in names])
    gammas, whole, every = graph.gammas, graph.whole, number % 2 == 0

    def choose(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                own = {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "at"}
                for r in np.unique(own["of_run"]):
                    there = slice(*np.searchsorted(own["of_run"], [r, r + 1]))
                    links = [own[c] if "run" not in own else own[c][own["run"] == r] for c in ("i", "j", "x")]
                    found = _choices(*links, *(own[f"of_{c}"][there] for c in names[1:]), gammas[r], whole, every)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), r, np.int32)), *map(pa.array, found)], ["run", "node", "k", "label", "to", "inside", "total"])

    return map_arrow(graph.listed().crossJoin(F.broadcast(state)), choose, "run int, node long, k long, label long, to long, inside long, total long")


def _places(node: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the numbers ``of`` are in the sorted ``node``, looked up in a table if that is not much larger."""
    low, high = int(node[0]), int(node[-1])
    if high - low > 16 * len(node):
        return np.searchsorted(node, of)
    table = np.zeros(high - low + 1, np.int64)
    table[node - low] = np.arange(len(node))
    return table[of - low]


def _choices(i, j, x, node, k, label, total, single, chooses, gamma: float, whole: float, every: bool) -> list[np.ndarray]:
    """Node, k, label, to, inside and total of the nodes whose links (i, j, x) these are, or of those among them that choose."""
    mine = _places(node, i)
    if not every:
        i, j, x, mine = (c[chooses[mine]] for c in (i, j, x, mine))
    if not len(i):
        return [np.zeros(0, np.int64)] * 6
    names, label_at = np.unique(label, return_inverse=True)
    key = mine * len(names) + label_at[_places(node, j)]
    order = np.argsort(key)
    key = key[order]
    # a row for each node and label that it has links to, labels in their order; its loop gives each node its own label
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    inside, key = np.add.reduceat(np.where(i == j, 0, x)[order], first), key[first]
    mine, to = key // len(names), key % len(names)
    begin = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(mine))))
    sums, alone = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    sums[label_at], alone[label_at] = total, single
    here = to == label_at[mine]
    gain = inside - gamma * k[mine].astype(float) * (sums[to] - np.where(here, k[mine], 0)) / (2 * whole)
    stay = gain[here]
    # two single nodes would only change places: the one with the larger label goes to the other
    gain[~here & ~(chooses[mine] & ~(single[mine] & alone[to] & (to > label_at[mine])))] = -np.inf
    most = np.maximum.reduceat(gain, begin)
    found = np.flatnonzero(gain == most[of])[::-1]
    best = np.empty(len(begin), int)
    best[of[found]] = found
    mine = mine[begin]
    return [node[mine], k[mine], label[mine], np.where(most > stay + whole * 1e-12, names[to[best]], label[mine]), inside[here], sums[to[here]]]


def _refined(graph: _Graph, labels: DataFrame) -> DataFrame:
    """(run, node, label, part): parts of each community, grown from single nodes.

    A node that is still alone and well connected to the rest of its community joins the well-connected part of largest
    gain. Only nodes whose turn it is move, and only to parts that stay in this round, so every part is connected.
    """
    inner = graph.inner(labels)
    whole = labels.groupBy("run", "label").agg(F.sum("k").alias("community"))
    rest = inner.groupBy("run", F.col("i").alias("node")).agg(F.sum("x").alias("inner"))
    k = F.col("k").cast("double")
    state = labels.join(whole, ["run", "label"]).join(rest, ["run", "node"]).withColumn("well", F.col("inner") >= graph.expected(k, F.col("community") - F.col("k")))
    # a node without links inside its community stays a part of its own
    state = graph.keep(state.select("run", "node", "label", "k", "community", "well", F.col("node").alias("part")), "parts")
    number, idle = 0, 0
    while idle < 2:
        seen = Tally()
        after = graph.keep(seen.on(_joined_parts(graph, inner, state, number), moved=F.sum(F.col("moved").cast("int"))), "parts")
        state, number, idle = after.drop("moved"), number + 1, 0 if seen.get("moved") else idle + 1
    return graph.keep(labels.join(state.select("run", "node", "part"), ["run", "node"], "left").select("run", "node", "label", F.coalesce("part", "node").alias("part")), "refined")


def _joined_parts(graph: _Graph, inner: DataFrame, state: DataFrame, number: int) -> DataFrame:
    ends = inner.join(graph.small(state.select("run", F.col("node").alias("j"), F.col("part").alias("to"))), ["run", "j"]).join(graph.small(state.select("run", F.col("node").alias("i"), F.col("part").alias("from"))), ["run", "i"]).filter("from <> to")
    cut = ends.groupBy("run", F.col("from").alias("part")).agg(F.sum("x").alias("cut"))
    sizes = state.groupBy("run", "part").agg(F.sum("k").alias("total"), F.count("*").alias("n"), F.max("community").alias("community"), F.min("node").alias("node"))
    total = F.col("total").cast("double")
    alone = F.col("n") == 1
    movers = state.join(graph.small(sizes.filter(alone).select("run", "part")), ["run", "part"]).filter(F.col("well") & graph.turn(number)).select("run", F.col("node").alias("i"), "k")
    targets = sizes.join(graph.small(cut), ["run", "part"]).filter((~alone | ~graph.turn(number)) & (F.col("cut") >= graph.expected(total, F.col("community") - F.col("total")))).select("run", F.col("part").alias("to"), "total")
    # only the links of those that may move are looked up; a mover is a part of its own, so all of its links lead to others
    options = inner.join(graph.small(movers), ["run", "i"]).join(graph.small(state.select("run", F.col("node").alias("j"), F.col("part").alias("to"))), ["run", "j"]).groupBy("run", "i", "to").agg(F.sum("x").alias("x"), F.max("k").alias("k")).join(graph.small(targets), ["run", "to"])
    options = options.withColumn("gain", F.col("x") - graph.expected(F.col("k").cast("double"), F.col("total"))).filter(F.col("gain") > graph.whole * 1e-12)
    best = options.groupBy("run", F.col("i").alias("node")).agg(F.min_by("to", F.struct(-F.col("gain"), "to")).alias("to"))
    return state.join(graph.small(best), ["run", "node"], "left").select("run", "node", "label", "k", "community", "well", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved"))


def _connected(graph: _Graph, labels: DataFrame) -> DataFrame:
    """(run, node, label): communities that fall apart are cut into their connected pieces; a piece's label is its least node.

    Nodes take the least label around them or that label's own label, so the rounds grow with the logarithm of the
    longest way.
    """
    inner = graph.inner(labels).filter("x > 0")
    now = labels.select("run", "node", F.col("node").alias("label"))
    while True:
        around = inner.join(graph.small(now.select("run", F.col("node").alias("j"), "label")), ["run", "j"]).groupBy("run", F.col("i").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(graph.small(around), ["run", "node"], "left").select("run", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(graph.small(now.select("run", F.col("node").alias("label"), F.col("label").alias("further"))), ["run", "label"])
        seen = Tally()
        label = F.least("label", "further")
        after = graph.keep(seen.on(jump, moved=F.sum((label < F.col("old")).cast("int"))).select("run", "node", label.alias("label")), "pieces")
        if not seen.get("moved"):
            return after
        now = after
