"""Component trees from ordered calls: G28.

A component's build method is a list of calls that open and close nodes. What a call does
hangs on the open nodes: a create first closes an open node that can't hold others, a pop
closes the top only if it has that name, a branch closes all down to the nearest If.

A root's calls are cut into segments, which are read side by side. A segment's effect on
whatever is open before it is a value: the closings that reach below the segment's own
nodes, in order, and the nodes that it leaves open. Effects compose, so one short pass over
a root's effects tells what is open before each segment, and only nodes that a segment hangs
on something from before it are looked up. Loop bodies are put in before, builders and
custom components after that, as copies of their own trees at each call.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.plans.fixpoint import fixpoint, stored

# Names with a meaning of their own.
IF, IF_BRANCH, BUILDER, VIEW, SLOT = "If", "IfBranch", "Builder", "View", "BuilderParam"
SPECIAL = (IF, IF_BRANCH, BUILDER, VIEW, "Repeat")
SEGMENT = 1_000  # calls of a root that are read together
INTO = -1  # in a place: what follows lies within the tree of a called root
PATH = "array<bigint>"


class Segment:
    """The open nodes of a segment, and what it closes of those before it.

    below: closings that reach below the own nodes: "-" closes the top if it can't hold
    others, "?name" if it has that name, "=name" all down to that name, "!" whatever it is.
    """

    def __init__(self, containers: frozenset[str]):
        self.containers, self.stack, self.below = containers, [], []

    def apply(self, closing: str) -> None:
        kind, name = closing[0], closing[1:]
        if kind == "=":
            while self.stack and self.stack[-1][1] != name:
                self.stack.pop()
            if not self.stack:
                self.below.append(closing)
        elif not self.stack:
            if kind != "-" or self.below[-1:] != ["-"]:  # a second one finds a holder: beneath the top are only holders
                self.below.append(closing)
        elif kind == "!" or (kind == "?" and self.stack[-1][1] == name) or (kind == "-" and self.stack[-1][1] not in self.containers):
            self.stack.pop()

    def call(self, op: str, name: str, path: list[int]) -> tuple[list[int] | None, int] | None:
        """For a call that makes a node: its parent's path, or else after how many closings of what was before."""
        if op == "drop":
            self.apply("!")
        elif op == "pop" and name == IF:
            self.apply(f"={IF}")
            self.apply("!")
        elif op == "pop":
            self.apply(f"?{name}")
        else:
            if op == "branch":
                self.apply(f"={IF}")
            self.apply("-")
            parent = (self.stack[-1][0], 0) if self.stack else (None, len(self.below))
            if op not in ("builder", "slot"):
                self.stack.append((path, name))
            return parent
        return None


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of one key in one partition, one after another."""
    keys = [c for c in order if c != "path"]
    return rows.repartition(*keys).sortWithinPartitions(*order)


def expand_bodies(ops: DataFrame) -> DataFrame:
    """root, path, op, name, callee: with the calls of loop bodies (loop, each) in their place.

    A body isn't put into itself.
    """
    own = ops.select("root", F.array(F.col("ord").cast("long")).alias("path"), "op", "name", "callee", F.array("root").alias("within"))
    body = stored(ops.where(F.col("root").isNotNull()).select(F.col("root").alias("_body"), F.col("ord").cast("long").alias("_ord"), F.col("op").alias("_op"), F.col("name").alias("_name"), F.col("callee").alias("_callee")))

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        calls = delta.where("op in ('loop', 'each') and not array_contains(within, callee)")
        rows = calls.join(body, F.col("callee") == F.col("_body"))
        return rows.select("root", F.concat("path", F.array("_ord")).alias("path"), F.col("_op").alias("op"), F.col("_name").alias("name"), F.col("_callee").alias("callee"), F.concat("within", F.array("callee")).alias("within"))

    rows = fixpoint(own, step, ["root", "path"]).drop("within")
    ends = rows.where("op = 'each'").select("root", F.concat("path", F.array(F.lit((1 << 63) - 1))).alias("path"), F.lit("drop").alias("op"), "name", F.lit(None).cast(rows.schema["callee"].dataType).alias("callee"))
    return rows.where("op <> 'each'").union(ends)


def own_trees(calls: DataFrame, containers: list[str], segment: int = SEGMENT) -> DataFrame:
    """root, path, op, name, callee, parent for each node that calls (expand_bodies) make."""
    holders, root = frozenset([*containers, *SPECIAL]), calls.schema["root"].dataType.simpleString()
    shown = F.when(F.col("op") == "branch", F.lit(IF_BRANCH)).when(F.col("op") == "builder", F.lit(BUILDER)).when(F.col("op") == "component", F.lit(VIEW)).otherwise(F.col("name"))
    rows = calls.select("root", F.floor(F.col("path")[0] / segment).alias("seg"), "path", "op", shown.alias("name"))

    def read(batches: Iterator) -> Iterator:
        """Nodes with their parents, and (path null) each segment's effect."""
        import pyarrow as pa

        key, now, out = None, None, []
        effect = lambda: (*key, None, None, None, now.below, [p for p, _ in now.stack], [n for _, n in now.stack])
        names = ["root", "seg", "path", "parent", "pending", "below", "open_paths", "open_names"]
        types = [None, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
        given = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for b in batches:
            types[0] = b.column(0).type
            for r, s, path, op, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, s) != key:
                    if key is not None:
                        out.append(effect())
                    key, now = (r, s), Segment(holders)
                parent = now.call(op, name, path)
                if parent is not None:
                    out.append((r, s, path, parent[0], parent[1] if parent[0] is None else None, None, None, None))
            if len(out) > 20_000:
                yield given()
                out = []
        if key is not None:
            out.append(effect())
            yield given()

    found = stored(_in_order(rows, "root", "seg", "path").mapInArrow(read, f"root {root}, seg long, path {PATH}, parent {PATH}, pending int, below array<string>, open_paths array<{PATH}>, open_names array<string>"))

    def follow(batches: Iterator) -> Iterator:
        """For each segment but a root's first: what is on top after so many of its closings."""
        import pyarrow as pa

        last, before = None, Segment(holders)
        for b in batches:
            out = []
            for r, s, below, paths, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != last:
                    last, before = r, Segment(holders)
                tops = [before.stack[-1][0] if before.stack else None]
                for closing in below:
                    before.apply(closing)
                    tops.append(before.stack[-1][0] if before.stack else None)
                before.stack += zip(paths, names, strict=True)
                out.append((r, s, tops))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.list_(pa.int64())))], names=["root", "seg", "tops"])

    effects = found.where("path is null").select("root", "seg", "below", "open_paths", "open_names")
    tops = effects.repartition("root").sortWithinPartitions("root", "seg").mapInArrow(follow, f"root {root}, seg long, tops array<{PATH}>")
    nodes = found.where("path is not null").select("root", "seg", "path", "parent", "pending")
    hung = nodes.where("pending is not null").join(tops, ["root", "seg"]).select("root", "path", F.col("tops")[F.col("pending")].alias("parent"))
    placed = nodes.where("pending is null").select("root", "path", "parent").union(hung)
    return placed.join(calls.select("root", "path", "op", shown.alias("name"), "callee"), ["root", "path"]).select("root", "path", "op", "name", "callee", "parent")


def assemble_component_tree(ops: DataFrame, containers: list[str], bindings: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """root, place, name, parent: the tree that each root's calls build, called trees put in.

    ops: root, ord, op, name, callee. create opens a node; pop closes it; branch opens a branch
    of the nearest If; loop opens a node and has the callee's calls follow; each has them
    follow and closes the top; builder is a node with the callee's tree; component opens a
    View with it; slot is a node that a builder given by the component's caller fills:
    bindings (root, ord, slot, callee) has it for that call.

    place: a node's path of calls, INTO before those of a called root; parent: another place,
    or null. Sorted by place, a root's nodes are in pre-order. containers: names of nodes that
    hold others. A root isn't put into itself. Null ops and pops of nothing do nothing.
    """
    calls = stored(expand_bodies(ops.where("op is not null")))
    own = stored(own_trees(calls, containers, segment))
    kind = own.schema["root"].dataType
    into = own.select(F.col("root").alias("_of"), F.col("path").alias("_path"), F.col("op").alias("_op"), F.col("name").alias("_name"), F.col("callee").alias("_callee"), F.col("parent").alias("_parent"))
    given = None
    if bindings is not None:
        given = stored(bindings.select(F.col("root").alias("_caller"), F.col("ord").cast("long").alias("_at"), F.col("slot").alias("_slot"), F.col("callee").alias("_given")))
    none = lambda t: F.lit(None).cast(t)
    seed = own.select("root", F.col("path").alias("place"), "name", "parent", "op", "callee", F.array("root").alias("within"), F.col("root").alias("of"), F.col("path")[0].alias("ord"), none(kind).alias("caller"), none("long").alias("caller_ord"))

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        rows = delta.where("op in ('builder', 'component') and callee is not null")
        if given is not None:
            slots = delta.where("op = 'slot'").join(given, (F.col("caller") == F.col("_caller")) & (F.col("caller_ord") == F.col("_at")) & (F.col("name") == F.col("_slot")))
            rows = rows.union(slots.withColumn("callee", F.col("_given")).select(delta.columns))
        rows = rows.where("not array_contains(within, callee)").join(into, F.col("callee") == F.col("_of"))
        deep = F.concat("place", F.array(F.lit(INTO).cast("long")))
        new = F.col("op") == "component"  # slots of its tree are filled by what its call gives
        return rows.select(
            "root", F.concat(deep, "_path").alias("place"), F.col("_name").alias("name"), F.when(F.col("_parent").isNull(), F.col("place")).otherwise(F.concat(deep, "_parent")).alias("parent"), F.col("_op").alias("op"),
            F.col("_callee").alias("callee"), F.concat("within", F.array("callee")).alias("within"), F.col("_of").alias("of"), F.col("_path")[0].alias("ord"), F.when(new, F.col("of")).otherwise(F.col("caller")).alias("caller"), F.when(new, F.col("ord")).otherwise(F.col("caller_ord")).alias("caller_ord"),
        )

    return fixpoint(seed, step, ["root", "place"]).select("root", "place", "name", "parent")


def with_depth(tree: DataFrame) -> DataFrame:
    """The nodes with their depth; a root's first nodes have 0."""
    down = tree.where("parent is not null").select("root", F.col("parent").alias("_up"), F.col("place").alias("_place"))
    step = lambda d, _: d.withColumnRenamed("root", "_root").join(down, (F.col("_root") == F.col("root")) & (F.col("place") == F.col("_up"))).select("root", F.col("_place").alias("place"), (F.col("depth") + 1).alias("depth"))
    depths = fixpoint(tree.where("parent is null").select("root", "place", F.lit(0).alias("depth")), step, ["root", "place"])
    return tree.join(depths, ["root", "place"])
