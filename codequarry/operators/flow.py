"""Dataflow, points-to and type analyses as semi-naive joins over relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from codequarry.operators.graph import by_doubling, connected_components, reachable, spread_join
from codequarry.plans.fixpoint import Dealt, dealt, fixpoint, stored

BATCH_ROWS = 50_000
PATH = ["start", "start_fact", "node", "fact"]
Flow = DataFrame | Callable[[DataFrame], DataFrame]


def dataflow_reach(seeds: DataFrame, normal: Flow, calls: Flow, returns: Flow, whole: bool = False) -> DataFrame:
    """Context-matched facts: path edges (start, start_fact, node, fact).

    seeds (node, fact) at starts of entry procedures; normal (node, fact, to, fact_to) within
    a procedure and past calls; calls (node, fact, callee, callee_fact) into a callee's start;
    returns (node, fact, call, to, fact_to) from a callee's end to after the call. Each is a
    relation, or a function that adds its last columns to path edges, so that flows over many
    facts need no table. A callee's end reaches only the callers that entered with the fact
    it started with; one entry fact is analysed once. whole: normal gives all that path edges
    lead to within their procedure, themselves included, so it is fed only those that come in.
    """
    normal, calls, returns = (_flow(f) for f in (normal, calls, returns))
    seed = seeds.select(F.col("node").alias("start"), F.col("fact").alias("start_fact"), "node", "fact")

    to = lambda rows: rows.select("start", "start_fact", F.col("to").alias("node"), F.col("fact_to").alias("fact"))
    seed = to(normal(seed)) if whole else seed

    def entered(paths: DataFrame) -> DataFrame:
        """Path edges at call nodes, with what they enter the callee with."""
        return calls(paths).select("start", "start_fact", F.col("node").alias("call"), "callee", "callee_fact")

    def left(paths: DataFrame) -> DataFrame:
        """Path edges at ends of callees, with where each return leads."""
        return returns(paths).select(F.col("start").alias("callee"), F.col("start_fact").alias("callee_fact"), "call", "to", "fact_to")

    meet = ["call", "callee", "callee_fact"]
    all_in, all_out = Dealt(entered(seed), meet), Dealt(left(seed), meet)

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        """Calls entered and left are kept as they are found, so known path edges aren't read again."""
        k = all_in.added
        new_in, new_out = all_in.add(entered(delta).distinct(), k).rows(k), all_out.add(left(delta).distinct(), k).rows(k)
        inside = new_in.select(F.col("callee").alias("start"), F.col("callee_fact").alias("start_fact"), F.col("callee").alias("node"), F.col("callee_fact").alias("fact"))
        across = inside.union(to(all_out.join(new_in))).union(to(all_in.join(new_out)))
        return to(normal(across)) if whole else to(normal(delta)).union(across)

    return fixpoint(seed, step, PATH)


def _flow(given: Flow) -> Callable[[DataFrame], DataFrame]:
    if callable(given):
        return given
    return dealt(given.withColumnsRenamed({"start": "callee", "start_fact": "callee_fact"}), ["node", "fact"]).join


def taint_flows(stmts: DataFrame, cfg: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """method, source, sink, fact: a value defined at a source block read at a sink block.

    stmts: method, block, def, use, one a block. A definition ends a variable's taint
    unless its own use is tainted; a tainted use taints what it defines.
    """
    after = cfg.select("method", F.col("src").alias("block"), F.col("dst").alias("_to"))
    onward = dealt(stmts.select("method", "block", "def", "use").join(after, ["method", "block"]), ["method", "block"])
    seed = onward.join(sources.select("method", "block")).select("method", F.col("block").alias("source"), F.col("_to").alias("block"), F.col("def").alias("fact"))

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        out = F.array_compact(F.array(F.when(F.col("def") != F.col("fact"), F.col("fact")), F.when(F.col("use") == F.col("fact"), F.col("def"))))
        return onward.join(delta).select("method", "source", F.col("_to").alias("block"), F.explode(out).alias("fact"))

    facts = fixpoint(seed, step, ["method", "source", "block", "fact"])
    at = sinks.join(stmts, ["method", "block"]).select("method", "block", F.col("use").alias("fact"))
    return facts.join(at, ["method", "block", "fact"]).select("method", "source", F.col("block").alias("sink"), "fact")


def open_uses(edges: list[tuple], rows: list[tuple], start: int) -> set[tuple]:
    """block, use of the rows (block, def, use) that start reaches past no block that defines the name."""
    bit = {name: 1 << k for k, name in enumerate({x for _, d, u in rows for x in (d, u)} - {None})}
    ends: dict = {}
    for block, defined, _ in rows:
        ends[block] = ends.get(block, 0) | bit.get(defined, 0)
    after: dict = {}
    for s, d in edges:
        after.setdefault(s, []).append(d)
    into, left = {start: (1 << len(bit)) - 1}, [start]
    while left:
        block = left.pop()
        out = into[block] & ~ends.get(block, 0)
        for d in after.get(block, ()):
            if out & ~into.get(d, 0):
                into[d] = into.get(d, 0) | out
                left.append(d)
    return {(block, use) for block, _, use in rows if into.get(block, 0) & bit.get(use, 0)}


def undefined_uses(stmts: DataFrame, cfg: DataFrame, start: int = 1) -> DataFrame:
    """method, block, name: uses that a variable's first definition may not have reached.

    A method is one row of statements and edges, walked in one task.
    """
    lists = stmts.where("method is not null and block is not null").groupBy("method").agg(F.collect_set(F.struct("block", "def", "use")).alias("rows"))
    edges = cfg.groupBy("method").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    method, block, name = (stmts.schema[c].dataType for c in ("method", "block", "use"))
    schema = StructType([StructField("method", method), StructField("block", block), StructField("name", name)])
    arrow = to_arrow_schema(schema)

    def walked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, blocks, names = [], [], []
            for k, (edges_, rows) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                found = open_uses([tuple(x.values()) for x in edges_.as_py() or ()], [tuple(x.values()) for x in rows.as_py()], start)
                at += [k] * len(found)
                blocks += [x for x, _ in found]
                names += [x for _, x in found]
                if len(at) >= BATCH_ROWS or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(blocks, arrow.field(1).type), pa.array(names, arrow.field(2).type)], schema=arrow)
                    at, blocks, names = [], [], []

    return lists.join(edges, "method", "left").select("method", "edges", "rows").mapInArrow(walked, schema)


def points_to(pag: DataFrame) -> DataFrame:
    """var, obj: inclusion-based points-to with fields, from pag (src, dst, kind, field).

    address: src is an object; copy; load: dst = src.field; write: dst.field = src. A cell
    (object, field) is a variable of its own, named by a pair.
    """
    none = F.lit(None).cast("long")
    node = lambda v, f=none: F.struct(v.cast("long").alias("v"), f.cast("long").alias("f"))
    kind = lambda k: pag.where(F.col("kind") == k)
    copies = stored(kind("copy").select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).distinct())
    loads = stored(kind("load").select(node(F.col("src")).alias("base"), "field", node(F.col("dst")).alias("b")).distinct())
    writes = stored(kind("write").select(node(F.col("dst")).alias("base"), "field", node(F.col("src")).alias("a")).distinct())
    seed = kind("address").select(node(F.col("dst")).alias("var"), F.col("src").alias("obj")).distinct()
    if loads.isEmpty() and writes.isEmpty():  # nothing but copies
        found = reachable(copies.select(F.col("a").alias("src"), F.col("b").alias("dst")), seed.select(F.col("obj").alias("root"), F.col("var").alias("node")))
        return found.select(F.col("node").alias("var"), F.col("root").alias("obj"))
    read, put = dealt(loads, ["base"]), dealt(writes, ["base"])
    edges, made, held = dealt(copies, ["a"]), Dealt(copies, ["a", "b"]), Dealt(seed, ["var"])

    def cells(paths: DataFrame) -> DataFrame:
        """Copy edges that these points-to rows of base variables make."""
        p = paths.select(F.col("var").alias("base"), F.col("obj").alias("o"))
        reads = read.join(p).select(node(F.col("o"), F.col("field")).alias("a"), "b")
        return reads.union(put.join(p).select("a", node(F.col("o"), F.col("field")).alias("b")))

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        """New rows go along all edges, all rows along new edges; both are kept as they are found."""
        k = made.added
        new = made.add(made.fresh(cells(delta)), k).rows(k)
        edges.add(new, k + 1)
        moved = lambda rows: rows.select(F.col("b").alias("var"), "obj")
        return moved(edges.join(delta, ["var"])).union(moved(held.add(delta, k).join(new, ["a"])))

    return fixpoint(seed, step, ["var", "obj"])


def variables(points: DataFrame) -> DataFrame:
    """var, obj for plain variables, without the cells of fields."""
    return points.where("var.f is null").select(F.col("var.v").alias("var"), "obj")


def points_to_ctx(pag: DataFrame, calls: DataFrame, k: int) -> DataFrame:
    """var, ctx, obj with call strings of at most k callees.

    pag: src, dst, kind (address, copy) within a method; calls: src, dst, callee: argument to
    parameter, which puts the callee before the caller's string. New strings are found on
    the way: a variable has a context once something flows to it under that context. What steps
    put before a string composes, so long paths go by squared steps.
    """
    if not 0 <= k <= 5:
        raise ValueError("k is 0 to 5")
    none = F.array().cast("array<bigint>")
    own = pag.where("kind = 'copy'").select(F.col("src").alias("var"), F.col("dst").alias("_to"), none.alias("_put"))
    given = calls.select("src", "dst", F.slice(F.array(F.col("callee").cast("long")), 1, k) if k else none)
    steps = stored(own.union(given).where("var is not null").distinct())
    seed = pag.where("kind = 'address'").select(F.col("dst").alias("var"), none.alias("ctx"), F.col("src").alias("obj"))

    def put(last, before):
        """What a string becomes: the last callees stand before the earlier ones."""
        return F.slice(F.concat(last, before), 1, k) if k else none

    def moved(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("_to").alias("var"), put("_put", "ctx").alias("ctx"), "obj")

    def squared(steps: DataFrame) -> DataFrame:
        first = steps.withColumnsRenamed({"var": "_from", "_to": "var", "_put": "_before"})
        return first.join(steps, "var").select(F.col("_from").alias("var"), "_to", put("_put", "_before").alias("_put")).distinct()

    return by_doubling(seed, steps, ["var"], moved, squared, ["var", "ctx", "obj"])


def may_alias(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of variables that share an object (var, obj)."""
    p = points.distinct()
    left, right = (p.select(F.col("var").alias(n), "obj") for n in ("a", "b"))
    return pairs.join(left, "a").join(right, ["b", "obj"]).select("a", "b").distinct()


def related_values(copies: DataFrame, start: DataFrame) -> DataFrame:
    """root, node: what is joined to each start value (id) by copies in either direction.

    Start values of one component are joined to the same values, so components are found
    once and met by a join; the pairs are never stored.
    """
    ids = stored(start.select(F.col("id").alias("root")).where("root is not null").distinct())
    parts = stored(connected_components(copies.where("src is not null and dst is not null")))
    roots = ids.join(parts.withColumnRenamed("id", "root"), "root").select("root", "component")
    alone = ids.join(roots, "root", "left_anti").select("root", F.col("root").alias("node"))
    blind = copies.where("(src is null) <> (dst is null)").select(F.coalesce("src", "dst").alias("node"))
    ends = roots.join(parts.withColumnRenamed("id", "node").join(blind, "node", "left_semi").select("component"), "component", "left_semi").select("root")
    ends = ends.union(alone.join(blind, "node", "left_semi").select("root")).select("root", F.lit(None).alias("node"))
    return alone.union(ends).union(spread_join(parts.withColumnRenamed("id", "node"), roots, ["component"]).select("root", "node"))


def type_mismatches(declared: DataFrame, points: DataFrame, types: DataFrame) -> DataFrame:
    """var, declared, found: variables that hold objects of other types than declared."""
    rows = points.join(types, "obj").groupBy("var").agg(F.array_sort(F.collect_set("type")).alias("found"))
    rows = declared.join(rows, "var").where(F.size(F.array_except("found", F.array("declared"))) > 0)
    return rows.select("var", "declared", F.array_join("found", ",").alias("found"))


def storage_links(sites: DataFrame) -> DataFrame:
    """Copy edges (src, dst) of app-storage calls (call, key, value, local).

    create: value to key; link: local and key both ways; prop: key to local; set on a linked
    local: value to local; get: key to local where the key is created or linked.
    """
    cell = F.concat(F.lit("key:"), "key")
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    value, local = F.col("value"), F.col("local")
    made = F.when(F.col("call") == "create", F.array(edge(value, cell))).when(F.col("call") == "link", F.array(edge(local, cell), edge(cell, local))).when(F.col("call") == "prop", F.array(edge(cell, local)))
    plain = sites.select(F.explode(made).alias("e")).select("e.*")
    linked = sites.where("call = 'link'").select("local").distinct()
    sets = sites.where("call = 'set'").join(linked, "local", "left_semi").select(value.alias("src"), local.alias("dst"))
    keys = sites.where("call in ('create', 'link')").select("key").distinct()
    gets = sites.where("call = 'get'").join(keys, "key", "left_semi").select(cell.alias("src"), local.alias("dst"))
    return plain.union(sets).union(gets).distinct()


def state_dependencies(edges: DataFrame, components: DataFrame, states: DataFrame) -> DataFrame:
    """component, state: state fields (node) that a component reads through locals and calls."""
    seen = reachable(edges, components.select(F.col("component").alias("root"), "node"))
    return seen.join(states, "node", "left_semi").select(F.col("root").alias("component"), F.col("node").alias("state"))


def infer_types(known: DataFrame, assigns: DataFrame, fields: DataFrame, reads: DataFrame) -> DataFrame:
    """var, type: types carried over assignments (src, dst) and field reads to a fixpoint.

    known (var, type); fields (type, field, field_type); reads (base, field, dst). A variable
    that takes several types keeps them all, as rows.
    """
    f = dealt(fields.select("type", "field", "field_type"), ["type", "field"])
    over_ = dealt(assigns.select(F.col("src").alias("var"), F.col("dst").alias("_to")), ["var"])
    into_ = dealt(reads.select(F.col("base").alias("var"), "field", F.col("dst").alias("_to")), ["var"])

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        over = over_.join(delta).select(F.col("_to").alias("var"), "type")
        into = f.join(into_.join(delta)).select(F.col("_to").alias("var"), F.col("field_type").alias("type"))
        return over.union(into)

    return fixpoint(known.select("var", "type"), step, ["var", "type"])


def pag_edges(assigns: DataFrame, calls: DataFrame, args: DataFrame, params: DataFrame, returns: DataFrame) -> DataFrame:
    """src, dst, kind, field from assignments and calls.

    assigns: left, left_kind, right, right_kind, field. Kinds: new, function, local, param,
    this, static, field, array. calls: site, callee, result; args (site, pos, value); params
    (callee, pos, name); returns (callee, value).
    """
    right, left = F.col("right_kind"), F.col("left_kind")
    kind = F.when(right.isin("new", "function"), "address").when(left.isin("field", "array"), "write").when(right.isin("field", "array"), "load").otherwise("copy")
    own = assigns.select(F.col("right").alias("src"), F.col("left").alias("dst"), kind.alias("kind"), F.when(kind.isin("write", "load"), F.col("field")).alias("field"))
    none = F.lit(None).cast("string")
    given = calls.join(args, "site").join(params, ["callee", "pos"]).select(F.col("value").alias("src"), F.col("name").alias("dst"), F.lit("copy").alias("kind"), none.alias("field"))
    back = calls.where("result is not null").join(returns, "callee").select(F.col("value").alias("src"), F.col("result").alias("dst"), F.lit("copy"), none)
    return own.union(given).union(back).distinct()
