"""Aggregations over findings, graphs and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROUNDS = range(6)


def count_by(findings: DataFrame, key: str) -> DataFrame:
    """Findings per key and round; a null key is left out."""
    return findings.where(F.col(key).isNotNull()).groupBy("round", key).agg(F.count(F.lit(1)).alias("n"))


def round_matrix(findings: DataFrame, key: str, rounds=ROUNDS) -> DataFrame:
    """A row for each key, a column for each round, 0 where there is none."""
    cells = [F.count(F.when(F.col("round") == r, 1)).alias(f"round_{r}") for r in rounds]
    return findings.where(F.col(key).isNotNull()).groupBy(key).agg(*cells)


def with_total_row(matrix: DataFrame, key: str, total: str = "Total") -> DataFrame:
    values = [c for c in matrix.columns if c != key]
    rows = matrix.rollup(key).agg(*[F.sum(c).alias(c) for c in values], F.grouping(key).alias("_g"))
    return rows.select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), *values)


def confusion_counts(pred: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Correct, false-positive and missed counts by single- or multi-defect file.

    A file's class is by its true findings; one without any counts as single.
    """
    kinds = truth.groupBy("file").agg(F.when(F.count(F.lit(1)) > 1, "multi").otherwise("single").alias("kind"))
    both = pred.select(*key, F.lit(1).alias("p")).join(truth.select(*key, F.lit(1).alias("t")), key, "full")
    both = both.join(kinds, "file", "left").withColumn("kind", F.coalesce("kind", F.lit("single")))
    count = lambda p, t: F.count(F.when(F.col("p").isNotNull() == p, F.when(F.col("t").isNotNull() == t, 1)))
    return both.groupBy("kind").agg(count(True, True).alias("correct"), count(True, False).alias("false_positive"), count(False, True).alias("missed"))


def remaining_by_round(findings: DataFrame, key: str) -> DataFrame:
    """key, round, left, drop (against the round before), reduction (against the first)."""
    w = W.partitionBy(key).orderBy("round")
    rows = findings.groupBy(key, "round").agg(F.count(F.lit(1)).alias("left"))
    first = F.first("left").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"drop": F.lag("left").over(w) - F.col("left"), "reduction": F.round(1 - F.col("left") / first, 6)})


def merge_groups(members: DataFrame) -> DataFrame:
    """Per group: its findings in order, distinct ranges, and the longest context."""
    return members.groupBy("path", "group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("findings"),
        F.size(F.collect_set(F.struct("start", "end"))).alias("n_ranges"),
        F.max_by("context", F.struct(F.length("context"), "context")).alias("context"),
    )


def roll_up_positions(blocks: DataFrame) -> DataFrame:
    """First start and last end of methods, classes and files from their blocks; 1 if empty.

    blocks: file, class, method, start, end.
    """
    span = [F.coalesce(F.min("start"), F.lit(1)).alias("start"), F.coalesce(F.max("end"), F.lit(1)).alias("end")]
    method = blocks.groupBy("file", "class", "method").agg(*span)
    klass = method.groupBy("file", "class").agg(*span)
    file = klass.groupBy("file").agg(*span)
    rows = [("method", method, F.col("method").cast("string")), ("class", klass, F.col("class").cast("string")), ("file", file, F.col("file").cast("string"))]
    out = [df.select(F.lit(level).alias("level"), name.alias("name"), "start", "end") for level, df, name in rows]
    return out[0].union(out[1]).union(out[2])


def counts_with_total(rows: DataFrame, key: str, total: str = "total") -> DataFrame:
    out = rows.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), "n")


def typing_stats(values: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row of counts over distinct values (value, type), against inferred (value, type)."""
    rows = values.dropDuplicates(["value"]).join(inferred.select("value", F.col("type").alias("got")), "value", "left")
    known, found = F.col("type").isNotNull(), F.col("got").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(count(~known & found).alias("from_unknown"), count(known & found & (F.col("type") != F.col("got"))).alias("different"), count(~known & ~found).alias("still_unknown"), F.count(F.lit(1)).alias("total"))


def edge_kind_stats(edges: DataFrame) -> DataFrame:
    """Edges and distinct ends per kind."""
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def callers_map(edges: DataFrame) -> DataFrame:
    """src and its distinct callees in order."""
    return edges.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: x.cast("string")), ",").alias("callees"))


def state_to_components(tree: DataFrame) -> DataFrame:
    """state field -> the components that depend on it, in order."""
    return tree.groupBy("state").agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"))


def corpus_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, distinct non-empty files, chunks."""
    a = files.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("content") != "", 1)).alias("full_files"))
    return a.join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))))
