"""Dominance and variable versions over control-flow graphs, a method at a time.

A method's dominator tree is one row a block: its immediate dominator, its depth, and two
numbers, when a walk of the tree enters and leaves the block. One block dominates another
if the numbers of the first enclose those of the second, so no list of dominators is kept.
Merges and versions of variables are read off the frontier and the same numbers, without recursion.

The walk itself is near-linear in a method's edges (semidominators with path compression).
A method is walked in one task, which holds some 200 bytes for each of its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from codequarry.plans.fixpoint import stored

BATCH_ROWS = 50_000


class Walk:
    """The blocks that start reaches, in the order of a depth-first walk, and their immediate dominators.

    above: the place of each block's immediate dominator; the start's is its own.
    """

    def __init__(self, src: list, dst: list, start):
        after: dict = {}
        for s, d in zip(src, dst, strict=True):
            after.setdefault(s, []).append(d)
        self.blocks, place, parent, way = [start], {start: 0}, [0], [(0, iter(after.get(start, ())))]
        while way:
            at, rest = way[-1]
            new = next((d for d in rest if d not in place), None)
            if new is None:
                way.pop()
                continue
            place[new] = len(self.blocks)
            way.append((len(self.blocks), iter(after.get(new, ()))))
            self.blocks.append(new)
            parent.append(at)
        self.before: list[set[int]] = [set() for _ in self.blocks]
        for s, d in zip(src, dst, strict=True):
            if s in place:
                self.before[place[d]].add(place[s])
        self.above = self._dominators(parent)

    def _dominators(self, parent: list[int]) -> list[int]:
        n = len(parent)
        semi, label, link = list(range(n)), list(range(n)), [-1] * n
        above, waiting = [0] * n, [[] for _ in range(n)]

        def least(v: int) -> int:
            """Of the linked blocks from v upwards, that with the smallest semidominator."""
            if link[v] < 0:
                return v
            path = [v]
            while link[link[path[-1]]] >= 0:
                path.append(link[path[-1]])
            for x in reversed(path[:-1]):
                up = link[x]
                if semi[label[up]] < semi[label[x]]:
                    label[x] = label[up]
                link[x] = link[up]
            return label[v]

        for w in range(n - 1, 0, -1):
            semi[w] = min((semi[least(v)] for v in self.before[w]), default=w)
            waiting[semi[w]].append(w)
            link[w] = parent[w]
            for v in waiting[parent[w]]:
                u = least(v)
                above[v] = u if semi[u] < semi[v] else parent[w]
            waiting[parent[w]] = []
        for w in range(1, n):
            if above[w] != semi[w]:
                above[w] = above[above[w]]
        return above

    def tree(self) -> Iterator[tuple]:
        """block, idom, depth, first, last in pre-order, children by number."""
        n = len(self.blocks)
        kids: list[list[int]] = [[] for _ in range(n)]
        for w in range(1, n):
            kids[self.above[w]].append(w)
        first, last, depth, clock = [0] * n, [0] * n, [0] * n, 0
        order, way = [], [(0, True)]
        while way:
            w, enter = way.pop()
            clock += 1
            if not enter:
                last[w] = clock
                continue
            first[w] = clock
            order.append(w)
            way.append((w, False))
            for k in sorted(kids[w], key=lambda k: self.blocks[k], reverse=True):
                depth[k] = depth[w] + 1
                way.append((k, True))
        for w in order:
            yield self.blocks[w], self.blocks[self.above[w]] if w else None, depth[w], first[w], last[w]

    def dominators(self) -> Iterator[tuple]:
        """block, dom: each block with all that dominate it, itself included."""
        for w, block in enumerate(self.blocks):
            at = w
            yield block, block
            while at:
                at = self.above[at]
                yield block, self.blocks[at]

    def frontier(self) -> Iterator[tuple]:
        """block, frontier: where a block's dominance stops."""
        found: list[set[int]] = [set() for _ in self.blocks]
        for w, before in enumerate(self.before):
            for at in before:
                # up from the predecessor to what dominates w strictly; the start has none above it
                while (w == 0 or at != self.above[w]) and w not in found[at]:
                    found[at].add(w)
                    if at == 0:
                        break
                    at = self.above[at]
        for at, ends in enumerate(found):
            for w in sorted(ends):
                yield self.blocks[at], self.blocks[w]


def _walks(blocks: DataFrame, cfg: DataFrame, start: int, rows_of: Callable[[Walk], Iterator[tuple]], schema: str) -> DataFrame:
    """What rows_of gives for each method's walk; schema: its columns, where {b} is the blocks' type."""
    method, block = blocks.schema["method"].dataType.simpleString(), blocks.schema["block"].dataType
    edges = cfg.select("method", F.col("src").cast(block), F.col("dst").cast(block)).groupBy("method").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    heads = blocks.where(F.col("block") == start).select("method").distinct()
    rows = heads.join(edges, "method", "left").select("method", F.coalesce("e.src", F.array()).cast(f"array<{block.simpleString()}>").alias("src"), F.coalesce("e.dst", F.array()).cast(f"array<{block.simpleString()}>").alias("dst"))
    schema = f"method {method}, " + schema.format(b=block.simpleString())
    types = to_arrow_schema(StructType.fromDDL(schema))

    def walked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, held = [], []

            def given() -> pa.RecordBatch:
                columns = [pa.array(x, types.field(k + 1).type) for k, x in enumerate(zip(*held, strict=True))]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], schema=types)  # noqa: B023

            for k, (src, dst) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for row in rows_of(Walk(src, dst, start)):
                    at.append(k)
                    held.append(row)
                    if len(at) >= BATCH_ROWS:
                        yield given()
                        at, held = [], []
            if at:
                yield given()

    return rows.mapInArrow(walked, schema)


def dominator_tree(blocks: DataFrame, cfg: DataFrame, start: int = 1) -> DataFrame:
    """method, block, idom, depth, first, last for each block that the start block reaches.

    a dominates b where a.first <= b.first and b.last <= a.last. The start has no idom.
    """
    return stored(_walks(blocks, cfg, start, Walk.tree, "block {b}, idom {b}, depth int, first int, last int"))


def dominators(blocks: DataFrame, cfg: DataFrame, start: int = 1) -> DataFrame:
    """method, block, dom: all dominators of each reachable block, itself included.

    The rows of a method grow with its blocks times their depth; ask the tree where a
    comparison is enough.
    """
    return _walks(blocks, cfg, start, Walk.dominators, "block {b}, dom {b}")


def dominance_frontier(blocks: DataFrame, cfg: DataFrame, start: int = 1) -> DataFrame:
    """method, block, frontier: x where block dominates a predecessor of x, not x strictly."""
    return stored(_walks(blocks, cfg, start, Walk.frontier, "block {b}, frontier {b}"))


def dominance_tree(tree: DataFrame) -> DataFrame:
    """method, block, parent, place: the tree in pre-order, children by number."""
    place = F.row_number().over(W.partitionBy("method").orderBy("first"))
    return tree.select("method", "block", F.col("idom").alias("parent"), place.alias("place"))


def _listed(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
    """method and its rows as a list of structs."""
    return rows.select("method", F.struct(*columns).alias("_x")).groupBy("method").agg(F.collect_list("_x").alias(name))


def _lists(column) -> list[list[tuple]]:
    """The structs of each list of a batch's column, read at once; none where a list is null."""
    offsets, values = column.offsets.to_pylist(), column.flatten()
    rows = [*zip(*(values.field(k).to_pylist() for k in range(values.type.num_fields)), strict=True)]
    return [rows[i - offsets[0] : j - offsets[0]] for i, j in zip(offsets, offsets[1:], strict=False)]


def phi_sites(defs: DataFrame, frontier: DataFrame, cfg: DataFrame) -> DataFrame:
    """method, block, name: where values of a variable (method, block, name) must be merged.

    A method's definitions are followed along its frontier in one task.
    """
    types = {"method": defs.schema["method"].dataType, "block": frontier.schema["frontier"].dataType, "name": defs.schema["name"].dataType}
    schema = StructType([StructField(n, t) for n, t in types.items()])
    arrow = to_arrow_schema(schema)
    lists = _listed(defs, "defs", F.col("block"), F.col("name"))
    lists = lists.join(_listed(frontier, "steps", F.col("block"), F.col("frontier")), "method").join(_listed(cfg, "edges", F.col("src"), F.col("dst")), "method")

    def followed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, blocks, names = [], [], []
            for k, (left, steps, edges) in enumerate(zip(*map(_lists, b.columns[1:]), strict=True)):
                after, before = {}, {}
                for block, to in steps:
                    after.setdefault(block, set()).add(to)
                for src, dst in edges:
                    before.setdefault(dst, set()).add(src)
                seen: set = set()
                while left:
                    block, name = left.pop()
                    new = {(to, name) for to in after.get(block, ()) if block is not None} - seen
                    seen |= new
                    left += new
                found = [x for x in seen if x[0] is not None and len(before.get(x[0], set()) - {None}) > 1]
                at += [k] * len(found)
                blocks += [x for x, _ in found]
                names += [x for _, x in found]
                if at and (len(at) >= BATCH_ROWS or k == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(blocks, arrow.field(1).type), pa.array(names, arrow.field(2).type)], schema=arrow)
                    at, blocks, names = [], [], []

    return lists.select("method", "defs", "steps", "edges").mapInArrow(followed, schema)


MERGE, DEFINITION = 0, 1


def held_versions(spans: list[tuple], defs: list[tuple], phis: list[tuple], asked: list[tuple], at_end: bool) -> Iterator[tuple[int, int]]:
    """place in asked, version: what holds for each (block, name) at its use, or at its block's end.

    spans: block, first, last; defs, phis: block, name. A site holds in all that its block
    dominates; of the sites that are open the last opened holds. Blocks without a span have no row.
    """
    sites = sorted([(b is not None, b, MERGE, x) for b, x in phis] + [(b is not None, b, DEFINITION, x) for b, x in set(defs)], key=lambda r: (r[0], r[1], r[2]) if r[0] else (False, 0, r[2]))
    numbers: dict = {}
    made: dict = {}
    for _, block, kind, name in sites:
        numbers[name] = numbers.get(name, 0) + 1
        made.setdefault(block, ([], []))[kind].append((name, numbers[name]))
    questions: dict = {}
    for k, (block, name) in enumerate(asked):
        questions.setdefault(block, []).append((k, name))
    open_: dict = {}
    for block, first, last in sorted((x for x in spans if x[0] is not None), key=lambda x: x[1]):
        merges, definitions = made.get(block, ((), ()))
        for name, version in merges:
            open_.setdefault(name, []).append((last, version))
        if at_end:
            for name, version in definitions:
                open_.setdefault(name, []).append((last, version))
        for k, name in questions.get(block, ()):
            held = open_.get(name, [])
            while held and held[-1][0] < first:
                held.pop()
            yield k, held[-1][1] if held else 0
        if not at_end:
            for name, version in definitions:
                open_.setdefault(name, []).append((last, version))


def _reaching(asked: DataFrame, at_end: bool, once: bool, defs: DataFrame, phis: DataFrame, tree: DataFrame) -> DataFrame:
    """asked (method, block, name, …) with the version that holds at its block's use, or end; a method is one task's row.

    once: equal questions have one answer.
    """
    schema = StructType([*asked.schema.fields, StructField("version", IntegerType())])
    arrow, others = to_arrow_schema(schema), [c for c in asked.columns if c != "method"]
    pair, first, second = (F.col("block"), F.col("name")), others.index("block"), others.index("name")
    lists = _listed(asked, "asked", *map(F.col, others)).join(_listed(tree, "spans", F.col("block"), F.col("first"), F.col("last")), "method")
    lists = lists.join(_listed(defs.select("method", *pair), "defs", *pair), "method", "left").join(_listed(phis.select("method", *pair), "phis", *pair), "method", "left")

    def walked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows, base = b.column(1).flatten(), b.column(1).offsets.to_pylist()
            at, place, versions = [], [], []
            for k, (rows_, *known) in enumerate(zip(*map(_lists, b.columns[1:]), strict=True)):
                questions, said = [(x[first], x[second]) for x in rows_], set()
                for i, version in held_versions(*known, questions, at_end):
                    if once and questions[i] in said:
                        continue
                    said.add(questions[i])
                    at.append(k)
                    place.append(base[k] - base[0] + i)
                    versions.append(version)
                if at and (len(at) >= BATCH_ROWS or k == b.num_rows - 1):
                    taken = rows.take(pa.array(place, pa.int64()))
                    columns = {"method": b.column(0).take(pa.array(at, pa.int64())), "version": pa.array(versions, pa.int32())} | {c: taken.field(c) for c in others}
                    yield pa.RecordBatch.from_arrays([columns[c] for c in arrow.names], schema=arrow)
                    at, place, versions = [], [], []

    return lists.select("method", "asked", "spans", "defs", "phis").mapInArrow(walked, schema)


def version_variables(defs: DataFrame, uses: DataFrame, phis: DataFrame, tree: DataFrame) -> DataFrame:
    """method, block, name, version: the definition that a use (method, block, name) reads.

    Versions number a name's merges and definitions by block, merges first; 0: none. A use
    stands before the definition of its own block, after its merges. Uses in blocks that
    the start doesn't reach have no row.
    """
    return _reaching(uses.select("method", "block", "name"), False, True, defs, phis, tree)


def phi_arguments(defs: DataFrame, phis: DataFrame, tree: DataFrame, cfg: DataFrame) -> DataFrame:
    """method, block, name, pred, version: what a merge takes from each predecessor; 0: nothing."""
    into = cfg.select("method", F.col("src").alias("pred"), F.col("dst").alias("block")).distinct()
    ends = phis.select("method", "block", "name").join(into, ["method", "block"]).select("method", F.col("pred").alias("block"), "name", F.col("block").alias("merge"))
    found = _reaching(ends, True, False, defs, phis, tree)
    return found.select("method", F.col("merge").alias("block"), "name", F.col("block").alias("pred"), "version")
