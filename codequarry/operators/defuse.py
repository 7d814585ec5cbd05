"""Definitions and the uses that they reach: G12.

A use reads the nearest definition before it in its block. Failing that, it reads every
definition that reaches the block's start: the last one of each name in a block goes on
along the edges until a block defines the name again. That part is worked out a method at a
time, with one bit for each last definition: what a block adds and ends are bit sets, and
what reaches it is OR-ed together until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.windows import nearest_def_in_block

BATCH_ROWS = 50_000


def reaching(edges: list[tuple], made: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
    """block, name, source: of each (block, name) asked for, the blocks whose definition reaches its start.

    edges: (from, to); made: the (block, name) that blocks define.
    """
    bit = {at: 1 << k for k, at in enumerate(made)}
    adds: dict = {}
    of_name: dict = {}
    for (block, name), b in bit.items():
        adds[block] = adds.get(block, 0) | b
        of_name[name] = of_name.get(name, 0) | b
    ends: dict = {}
    for block, name in made:
        ends[block] = ends.get(block, 0) | of_name[name]
    after: dict = {}
    for s, d in edges:
        after.setdefault(s, []).append(d)
    into: dict = {}
    out = dict(adds)
    left = list(adds)
    while left:
        block = left.pop()
        for d in after.get(block, ()):
            more = out[block] & ~into.get(d, 0)
            if more:
                into[d] = into.get(d, 0) | more
                gone = more & ~ends.get(d, 0) & ~out.get(d, 0)
                if gone:
                    out[d] = out.get(d, 0) | gone
                    left.append(d)
    for block, name in asked:
        found = into.get(block, 0) & of_name.get(name, 0)
        while found:
            low = found & -found
            yield block, name, made[low.bit_length() - 1][0]
            found ^= low


def reaching_definitions(defs: DataFrame, uses: DataFrame, cfg: DataFrame) -> DataFrame:
    """method, name, def_block, use_block: blocks that define a name, and uses (method, block, name) that they reach from outside.

    A method is one row of edges, definitions and uses, walked in one task.
    """
    pair = lambda rows, name: rows.select("method", "block", "name").distinct().groupBy("method").agg(F.sort_array(F.collect_list(F.struct("block", "name"))).alias(name))
    edges = cfg.select("method", "src", "dst").distinct().groupBy("method").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    rows = edges.join(pair(defs, "made"), "method").join(pair(uses, "asked"), "method").select("method", "edges", "made", "asked")
    method, block, name = (t.dataType.simpleString() for t in (uses.schema["method"], uses.schema["block"], uses.schema["name"]))

    def walked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            block_type = b.column(2).type.value_type.field(0).type
            at, found = [], []

            def given() -> pa.RecordBatch:
                blocks, names, sources = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(names, pa.string()), pa.array(sources, block_type), pa.array(blocks, block_type)], names=["method", "name", "def_block", "use_block"])  # noqa: B023

            for k in range(b.num_rows):
                edges_, made, asked = ([tuple(x.values()) for x in b.column(c)[k].as_py()] for c in (1, 2, 3))
                for row in reaching(edges_, made, asked):
                    at.append(k)
                    found.append(row)
                    if len(at) >= BATCH_ROWS:
                        yield given()
                        at, found = [], []
            if at:
                yield given()

    return rows.mapInArrow(walked, f"method {method}, name {name}, def_block {block}, use_block {block}")


def statement_chains(defs: DataFrame, uses: DataFrame, cfg: DataFrame) -> DataFrame:
    """method, name, def_block, def_idx, use_block, use_idx for blocks of many statements.

    defs and uses: method, block, idx, name. A use stands before the definition of its own
    statement.
    """
    near = nearest_def_in_block(defs, uses.distinct())
    inside = near.where("def_idx is not null").select("method", "name", F.col("block").alias("def_block"), "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx"))
    open_ = near.where("def_idx is null").select("method", "name", F.col("block").alias("use_block"), F.col("idx").alias("use_idx"))
    last = defs.groupBy("method", F.col("block").alias("def_block"), "name").agg(F.max("idx").alias("def_idx"))
    found = reaching_definitions(defs, open_.select("method", F.col("use_block").alias("block"), "name"), cfg)
    outside = open_.join(found, ["method", "name", "use_block"]).join(last, ["method", "def_block", "name"])
    return inside.union(outside.select(inside.columns))


def def_use_chains(defs: DataFrame, uses: DataFrame, cfg: DataFrame) -> DataFrame:
    """method, name, def_block, use_block: definitions that reach a use from other blocks, or around a loop.

    One statement a block: its use comes before its definition.
    """
    return reaching_definitions(defs, uses, cfg)
