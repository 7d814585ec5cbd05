"""Graph analytics over edge tables (graph keys are part of the node columns)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.plans.fixpoint import Dealt, dealt, fixpoint, stored


HOPS, MOST_JUMPS = 16, 8
ROOTS = 256  # start nodes whose bits are one row
PARTS = 16  # that a key's rows are dealt over where a join's output is far larger than its input


def spread_join(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """many joined with few on equal keys, where a handful of keys may hold most rows.

    A key's rows of ``many`` are dealt over PARTS parts and those of ``few`` go to all of them, so
    what is shuffled grows with the input, not with the output. The number of partitions is
    fixed: they are small before the join and must not be merged for that.
    """
    n = max(2 * PARTS, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(PARTS)).cast("int")).repartition(n, *on, "_part")
    copied = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(n, *on, "_part")
    return dealt.join(copied, [*on, "_part"]).drop("_part")


def connected_components(edges: DataFrame, max_iter: int = 100) -> DataFrame:
    """id, component (its smallest id), for the nodes of edges (src, dst), undirected.

    Alternating large and small stars: the least neighbour is joined to a node's other
    neighbours, never grouped with them, so a hot node is no single task's burden.
    """
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_iter):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stored(large)
        least = stored(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stored(small.union(least.select("w", "m")).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if state == before:
            top = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(top).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {max_iter} rounds")


def build_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "kind"])


def build_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """id, attr: the last attribute of each node wins."""
    return nodes.groupBy("id").agg(F.max_by("attr", order).alias("attr"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge; blank ones don't count."""
    return nodes.where("name <> ''").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, key: tuple = ()) -> DataFrame:
    """key, root, node: all nodes that start (key, root, node) reaches, itself included.

    edges (key, src, dst); key columns keep many graphs apart. The first HOPS rounds go
    edge by edge. Where paths are longer, as in chains, the edges are squared until one
    stands for HOPS steps, and each further round doubles the length that is covered. If
    these jumps grow past MOST_JUMPS for each edge, the rest goes by the longest that didn't.
    """
    e = stored(edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("_to")).distinct())
    names = [*key, "root", "node"]

    def moved(rows: DataFrame) -> DataFrame:
        return rows.select(*key, "root", F.col("_to").alias("node"))

    def squared(steps: DataFrame) -> DataFrame:
        first = steps.withColumnsRenamed({"node": "_from", "_to": "node"})
        return first.join(steps, [*key, "node"]).select(*key, F.col("_from").alias("node"), "_to").distinct()

    return by_doubling(start.select(names), e, [*key, "node"], moved, squared, names)


def by_doubling(start: DataFrame, steps: DataFrame, by: list[str], moved: Callable, squared: Callable, names: list[str]) -> DataFrame:
    """All rows (names) that start leads to: HOPS rounds step by step, then by squared steps.

    moved: where rows joined with steps on ``by`` get to; squared: steps twice as long, distinct.
    If these grow past MOST_JUMPS for each step, the rest goes by the longest that didn't.
    """

    def by_steps(rows: DataFrame, steps: DataFrame, rounds: int | None = None) -> DataFrame:
        onward = dealt(steps, by)
        return fixpoint(rows, lambda d, _: moved(onward.join(d)), names, rounds)

    known = by_steps(start, steps, HOPS)
    jumps, width, most = steps, 1, None
    while True:
        new = stored(moved(known.join(jumps, by)).distinct().join(known, names, "left_anti").select(names)) if width == 1 or width >= HOPS else None
        if new is not None and new.isEmpty():
            return known
        if new is not None:
            known = stored(known.union(new))
        most = steps.count() * MOST_JUMPS if most is None else most
        longer = stored(squared(jumps))
        if longer.count() > most:  # known reaches farther than these jumps, so they miss nothing
            return by_steps(known, jumps)
        jumps, width = longer, 2 * width


def reachable_past_hub(edges: DataFrame, start: DataFrame) -> DataFrame:
    """As reachable, for many start nodes of one graph (root, node) of which most reach the same large part.

    The hub is the node with the most edges in and out. What it reaches is found once; a root that
    reaches the hub gets that by a join, and is followed only where the hub doesn't reach. Other roots are
    followed as they are. So only the rest, not all pairs, is written and compared.
    """
    every = stored(edges.select("src", "dst").where("src is not null").distinct())
    e, blind = every.where("dst is not null"), every.where("dst is null").select(F.col("src").alias("node"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    hub = out.join(into, "id").orderBy(F.desc(F.col("n_in") * F.col("n_out")), "id").select(F.col("id").alias("root"), F.col("id").alias("node")).limit(1)
    hub = stored(hub)
    beyond = stored(reachable(e, hub).select("node"))
    before = stored(reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hub).select("node"))
    start = stored(start.select("root", "node").distinct())
    through = stored(start.join(before, "node", "left_semi").select("root").distinct())
    # roots through the hub are followed outside what it reaches, the others can't get to the hub
    outside = stored(e.join(beyond.withColumnRenamed("node", "src"), "src", "left_anti").join(beyond.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    own = reachable(outside, start.join(through, "root", "left_semi").join(beyond, "node", "left_anti").select("root", "node"))
    rest = reachable(e, start.join(through, "root", "left_anti"))
    few = own.union(rest)
    if not blind.isEmpty():  # edges to null
        ends = few.join(blind, "node", "left_semi").select("root")
        ends = ends if beyond.join(blind, "node", "left_semi").isEmpty() else ends.union(through)
        few = few.union(ends.distinct().withColumn("node", F.lit(None)))
    shared = spread_join(beyond.withColumn("_all", F.lit(0)), through.withColumn("_all", F.lit(0)), ["_all"]).select("root", "node")
    return few.union(shared)


def closure(edges: DataFrame) -> DataFrame:
    """root, node: pairs joined by a path of one edge or more. Output is all pairs."""
    return reachable(edges, edges.select(F.col("src").alias("root"), F.col("dst").alias("node")))


def _least_before(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label: the smallest node that reaches each node (itself included)."""
    e = edges.select(F.col("src").alias("id"), F.col("dst").alias("_to"))
    labels = changed = stored(nodes.select("id", F.col("id").alias("label")))
    while not changed.isEmpty():  # labels only fall; only those that fell are sent on
        came = changed.join(e, "id").groupBy(F.col("_to").alias("id")).agg(F.min("label").alias("_came"))
        both = stored(labels.join(came, "id", "left").select("id", F.least("label", F.coalesce("_came", "label")).alias("label"), F.coalesce(F.col("_came") < F.col("label"), F.lit(False)).alias("_new")))
        labels, changed = both.drop("_new"), both.where("_new").drop("_new")
    return labels


def _through(edges: DataFrame) -> DataFrame:
    """id, head, tail of nodes with one edge in and one out: what lies before and after them."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("tail")).where("_n = 1")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_m"), F.min("src").alias("head")).where("_m = 1")
    return out.join(into, F.col("src") == F.col("dst")).select(F.col("src").alias("id"), "head", "tail")


def _along_chains(through: DataFrame, n: int) -> DataFrame:
    """id, head, tail, low, ring: the chain of each through node, from its first node before to its first after.

    Pointers jump twice as far each round. Nodes whose pointers never leave are rings of such
    nodes alone; low is the smallest of a ring.
    """
    rows = stored(through.withColumn("low", F.col("id")))
    for _ in range(n.bit_length() + 1):
        ahead = rows.select(F.col("id").alias("_a"), F.col("tail").alias("_tail"), F.col("low").alias("_low"))
        back = rows.select(F.col("id").alias("_b"), F.col("head").alias("_head"))
        both = rows.join(ahead, F.col("tail") == F.col("_a"), "left").join(back, F.col("head") == F.col("_b"), "left")
        rows = stored(both.select("id", F.coalesce("_head", "head").alias("head"), F.coalesce("_tail", "tail").alias("tail"), F.least("low", F.coalesce("_low", "low")).alias("low"), (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("ring")))
        if rows.where("ring").isEmpty():
            break
    return rows


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, scc (its smallest node), in_cycle.

    While at least half of the nodes have one edge in and one out, chains of them are
    contracted to one edge each: such a node is in its neighbours' component if both of its
    chain's ends are in one, else alone. The rest goes to ``_core_components``.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    live, live_edges, chains = stored(nodes.select("id").distinct()), stored(edges.where("src <> dst").select("src", "dst").distinct()), []
    while True:
        through = stored(_through(live_edges))
        n = through.count()
        if not n or 2 * n < live.count():
            break
        rows = _along_chains(through, n)
        chains.append(rows)
        ids = rows.select("id")
        direct = live_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        live_edges = stored(direct.union(rows.where("not ring and head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct())
        live = stored(live.join(ids, "id", "left_anti"))
    done = _core_components(live, live_edges)
    for rows in reversed(chains):
        ends = lambda c: done.select(F.col("id").alias(c), F.col("scc").alias(f"_{c}"))  # noqa: B023, E731
        open_ = rows.where("not ring").join(ends("head"), "head", "left").join(ends("tail"), "tail", "left")
        found = open_.select("id", F.when(F.col("_head") == F.col("_tail"), F.col("_head")).otherwise(F.col("id")).alias("scc"))
        done = stored(done.union(found).union(rows.where("ring").select("id", F.col("low").alias("scc"))))
    sizes = done.groupBy("scc").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    rows = done.join(sizes, "scc").join(loops.withColumn("_l", F.lit(True)), "id", "left")
    return rows.select("id", F.col("_least").alias("scc"), (F.coalesce("_l", F.lit(False)) | (F.col("_n") > 1)).alias("in_cycle"))


def _core_components(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """id, scc (one of its nodes) over edges without loops.

    Nodes without a live predecessor or successor are trimmed, each its own component.
    Of the rest each takes the smallest node that reaches it as colour; a colour's root and
    what reaches it backwards in that colour are one component, and leave the graph.
    """
    live, live_edges, done = nodes, all_edges, None
    while True:  # each round takes at least one component out
        while True:
            kept = live.join(live_edges.select(F.col("dst").alias("id")), "id", "left_semi").join(live_edges.select(F.col("src").alias("id")), "id", "left_semi")
            kept = stored(kept)
            if kept.count() == live.count():
                break
            gone = live.join(kept, "id", "left_anti").select("id", F.col("id").alias("scc"))
            done = gone if done is None else done.union(gone)
            live = kept
            live_edges = stored(live_edges.join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if live.isEmpty():
            break
        colour = _least_before(live_edges, live)
        same = live_edges.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = stored(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        start = colour.where("id = label").select(F.col("id").alias("root"), F.col("id").alias("node"))
        found = stored(reachable(back, start).select(F.col("node").alias("id"), F.col("root").alias("scc")))
        done = found if done is None else done.union(found)
        live = stored(live.join(found, "id", "left_anti"))
        live_edges = stored(live_edges.join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return stored(done if done is not None else nodes.select("id", F.col("id").alias("scc")))


def condense_topo(components: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, level: components by the longest path to them from a source component."""
    c = components.select("id", "scc")
    e = edges.join(c.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("scc").alias("b")), "dst")
    e = stored(e.where("a <> b").select("a", "b").distinct())
    seed = c.select("scc", F.lit(0).alias("level")).distinct()
    levels = raised = stored(seed)
    while not raised.isEmpty():  # a component's level only rises, and never past their number
        came = raised.join(e, F.col("scc") == F.col("a")).groupBy("b").agg(F.max(F.col("level") + 1).alias("_came"))
        both = levels.join(came, F.col("scc") == F.col("b"), "left")
        both = stored(both.select("scc", F.greatest("level", F.coalesce("_came", "level")).alias("level"), F.coalesce(F.col("_came") > F.col("level"), F.lit(False)).alias("_up")))
        levels, raised = both.drop("_up"), both.where("_up").drop("_up")
    return levels


def unreachable_blocks(blocks: DataFrame, cfg: DataFrame, start: int = 1) -> DataFrame:
    """Blocks (method, block) that the start block doesn't reach."""
    seed = blocks.where(F.col("block") == start).select("method", F.col("block").alias("root"), F.col("block").alias("node"))
    seen = reachable(cfg, seed, ("method",)).select("method", F.col("node").alias("block"))
    return blocks.join(seen, ["method", "block"], "left_anti")


def tree_walk(tree: DataFrame, condition) -> DataFrame:
    """root, node, found: whether the subtree of a node holds one that meets the condition."""
    up = dealt(tree.where("parent is not null").select("root", "node", F.col("parent").alias("_to")), ["root", "node"])
    seed = tree.where(condition).select("root", "node")
    hit = fixpoint(seed, lambda d, _: up.join(d).select("root", F.col("_to").alias("node")), ["root", "node"])
    return tree.select("root", "node").join(hit.withColumn("found", F.lit(True)), ["root", "node"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def dependency_order(edges: DataFrame, start: DataFrame) -> DataFrame:
    """root, node, hops: the files that each start file (id) needs, and over how few imports.

    edges: src imports dst. Only shortest distances are kept, so rings end too.
    Starts are numbered and dealt into groups of ROOTS; for a node and a group a round keeps one row,
    a bit for each start that comes there first in this round. Pairs are made in the result only.
    """
    e = dealt(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct(), ["node"])
    words = [f"_b{k}" for k in range(ROOTS // 64)]
    numbered = start.select(F.col("id").alias("root")).distinct().withColumn("_n", F.monotonically_increasing_id())
    at = F.col("_n") % ROOTS
    group = F.floor(F.col("_n") / ROOTS).cast("long").alias("_group")
    roots_ = stored(numbered.select("root", group, F.floor(at / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(_n % 64 as int))").alias("_bit")), "starts")
    # the group is a start's own, so one row of a start has one bit
    seed = roots_.select(F.col("root").alias("node"), "_group", F.lit(0).alias("hops"), *(F.when(F.col("_word") == k, F.col("_bit")).otherwise(0).alias(w) for k, w in enumerate(words)))
    known = Dealt(seed, ["node", "_group"])
    new = known.unseen(seed, words)
    for k in itertools.count():
        known.add(new, k)
        delta = known.rows(k)
        if delta.isEmpty():
            break
        new = known.unseen(e.join(delta).select(F.col("_to").alias("node"), "_group", (F.col("hops") + 1).alias("hops"), *words), words)
    rows = known.rows().select("node", "_group", "hops", F.array(*words).alias("_words"))
    rows = rows.join(roots_, "_group").where(F.element_at("_words", F.col("_word") + 1).bitwiseAND(F.col("_bit")) != 0)
    return rows.select("root", "node", "hops")


def import_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that import each other in a ring: id, scc."""
    return strong_components(nodes, edges).where("in_cycle").select("id", "scc")
