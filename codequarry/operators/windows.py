"""Window operators over findings, ranges, statements, lines and tokens; sets and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.operators.text import with_balance
from codequarry.plans.fixpoint import stored


def dedup_findings(findings: DataFrame, key: tuple = ("path", "rule", "line"), order: str = "event_id") -> DataFrame:
    """The first finding of each key."""
    return findings.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def first_per_rule(findings: DataFrame, group: str, order: tuple) -> DataFrame:
    return findings.withColumn("_r", F.row_number().over(W.partitionBy(group, "rule").orderBy(*order))).where("_r = 1").drop("_r")


def global_rank(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rn from 1 in a total order, without sorting in one task.

    Rows are dealt by range; each part is numbered, and parts' sizes are summed. The
    numbered rows are stored, so that both uses see the same parts.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts.withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1), "ranked")
    sizes = parts.groupBy("_part").count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("rn", F.col("_k") + F.col("_before")).drop("_part", "_k", "_p", "_before")


def head_split(rows: DataFrame, key: str, share: int = 10) -> DataFrame:
    """rows with split: the first share per cent in order of key are test, the rest train."""
    ranked = global_rank(rows, key)
    n = rows.agg(F.floor(F.count(F.lit(1)) * share / 100).alias("_n"))  # one row
    return ranked.join(F.broadcast(n)).withColumn("split", F.when(F.col("rn") <= F.col("_n"), "test").otherwise("train")).drop("_n")


def merge_ranges(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Ranges that overlap or touch, merged: key, start, end, n."""
    w = W.partitionBy(key).orderBy("start", "end")
    past = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (past.isNull() | (F.col("start") > past + 1)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def nearest_def_in_block(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """uses (method, block, idx, name) with def_idx: the closest earlier definition, or null."""
    both = defs.select("method", "block", "idx", "name", F.lit(1).alias("is_def")).union(uses.select("method", "block", "idx", "name", F.lit(0)))
    w = W.partitionBy("method", "block", "name").orderBy("idx", "is_def")
    last = F.last(F.when(F.col("is_def") == 1, F.col("idx")), ignorenulls=True)
    # a statement's own definition comes after its use
    return both.withColumn("def_idx", last.over(w.rowsBetween(W.unboundedPreceding, -1))).where("is_def = 0").drop("is_def")


def next_place(heads: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """key, head, next: the first place (key, line_no) of the same key after each head, or null.

    Heads and places are sorted together once for each key, not joined.
    """
    both = heads.select(*key, F.col("head").alias("_at"), F.lit(True).alias("_ask")).union(places.select(*key, "line_no", F.lit(False)))
    after = W.partitionBy(*key).orderBy("_at", "_ask").rowsBetween(1, W.unboundedFollowing)
    rows = both.withColumn("next", F.first(F.when(~F.col("_ask"), F.col("_at")), ignorenulls=True).over(after))
    return rows.where("_ask").select(*key, F.col("_at").alias("head"), "next")


def block_end(lines: DataFrame, is_head: Column) -> DataFrame:
    """path, head, end: the line where the balance, 1 after the head line, first is 0.

    Braces of the head line itself aren't counted, blank lines are passed over, and a
    block that never closes ends with its file.
    """
    rows = with_balance(lines)
    heads = rows.where(is_head).select("path", F.col("line_no").alias("head"), (F.col("cum") - 1).alias("cum"))
    ends = rows.where(F.trim("text") != "").select("path", "line_no", "cum")
    found = next_place(heads, ends, ["path", "cum"]).select("path", "head", F.col("next").alias("end"))
    last = lines.groupBy("path").agg(F.max("line_no").alias("_last"))
    return found.join(last, "path").select("path", "head", F.coalesce("end", "_last").alias("end"))


def slide_chunks(rows: DataFrame, size: int, overlap: int, begin: str = "<s>", end: str = "</s>", pad: str = "<pad>") -> DataFrame:
    """path, chunk_no, tokens: windows of size - 2 tokens, framed, the last ones padded."""
    step = size - overlap
    rows = rows.where(F.size("tokens") > 0).select("path", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step))).alias("i"))
    framed = F.concat(F.array(F.lit(begin)), F.slice("tokens", F.col("i") + 1, F.lit(size - 2)), F.array(F.lit(end)))
    padded = F.concat(framed, F.array_repeat(F.lit(pad), F.lit(size) - F.size(framed)))
    return rows.select("path", F.floor(F.col("i") / step).cast("int").alias("chunk_no"), padded.alias("tokens"))


def slide_chunks_with_header(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of tokens that begin with header; later ones repeat it and keep what fits."""
    step, room = size - overlap, size - 2
    all_ = F.concat("header", "tokens")
    rows = rows.select("path", "header", all_.alias("all"), F.explode(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(step))).alias("i"))
    chunk = F.slice("all", F.col("i") + 1, F.lit(room))
    keep = F.least(F.size(chunk), F.lit(room) - F.size("header"))
    tail = F.concat("header", F.slice(chunk, F.size(chunk) - keep + 1, keep))
    return rows.select("path", F.floor(F.col("i") / step).cast("int").alias("chunk_no"), F.when(F.col("i") == 0, chunk).otherwise(tail).alias("tokens"))


def prefix_target(files: DataFrame, seed: int = 7, least: int = 8, every: int = 100) -> DataFrame:
    """path, k, prev, target: one seeded cut for each ``every`` lines, from line ``least`` on.

    The cut comes of the md5 of path, k and seed, so that reruns agree.
    """
    ls = F.split("content", "\n")
    long_enough = F.size(ls) >= max(every, least + 1)
    rows = files.where(long_enough).select("path", ls.alias("ls"), F.explode(F.sequence(F.lit(1), F.floor(F.size(ls) / every).cast("int"))).alias("k"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "path", "k", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    cut = (drawn % (F.size("ls") - least) + least).cast("int")
    return rows.withColumn("cut", cut).select("path", "k", F.array_join(F.slice("ls", F.lit(1), F.col("cut")), "\n").alias("prev"), F.array_join(F.slice("ls", F.col("cut") + 1, F.size("ls")), "\n").alias("target"))


def order_findings(findings: DataFrame, key: str, *ties: str) -> DataFrame:
    """findings with their place by line within key; a missing line counts as 0."""
    return findings.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("line", F.lit(0)), *ties)))


def union_sources(*scans: DataFrame) -> DataFrame:
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def new_only(found: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return found.join(seen, key, "left_anti")


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
