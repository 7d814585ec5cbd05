"""Semi-naive iteration on stored tables: the kernel of the recursive operators.

Each round's new rows are written under the shared folder (spark.checkpoint.dir), so
lineage stays short and a lost executor costs one round's tasks at most. What a round meets
again and again lies in buckets, so that only the newest rows are shuffled.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset in local mode, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codequarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """df written as a table in the shared folder, and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MERGED = 40
MOST_BUCKETS = 48


class Dealt:
    """Stored rows in buckets by a hash of the columns ``by``: a join on these shuffles only the other side.

    Rows can be added, each time under a round number. Every MERGED additions the files of a
    bucket become one. Structs and arrays can't be bucketed, so the hash is a column, ``_key``.
    """

    def __init__(self, like: DataFrame, by: list[str]):
        self.spark, self.by = like.sparkSession, by
        self.types = {f.name: f.dataType.simpleString() for f in like.schema}  # by name, so that all may be null
        self.n = min(MOST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.added = 0
        self._start()

    def _start(self) -> None:
        self.path = new_path(self.spark, "dealt")
        self.name = "dealt_" + self.path.rsplit("-", 1)[1]

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("_round").bucketBy(self.n, "_key").option("path", self.path).format("parquet").saveAsTable(self.name)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows, with the columns' types and the hash."""
        typed = rows.select(*(F.col(c).cast(t).alias(c) for c, t in self.types.items()))
        return typed.withColumn("_key", F.xxhash64(*self.by))

    def add(self, rows: DataFrame, round_: int = 0) -> Dealt:
        """Add rows; those of ``fresh`` are dealt already."""
        rows = rows if "_key" in rows.columns else self.keyed(rows).repartition(self.n, "_key")
        self._write(rows.withColumn("_round", F.lit(round_)))
        self.added += 1
        if self.added % MERGED == 0:
            old = self.spark.table(self.name)
            self._start()
            self._write(old.withColumn("_round", F.when(F.col("_round") == round_, round_).otherwise(-1)))
        return self

    def rows(self, round_: int | None = None) -> DataFrame:
        all_ = self.spark.table(self.name)
        return (all_ if round_ is None else all_.where(F.col("_round") == round_)).select(*self.types)

    def _same(self, a: list, b: list):
        """Equality that isn't a join key of its own: the hash is the only one, as the buckets are by it."""
        pair = lambda columns: F.struct(*(c.alias(f"_{k}") for k, c in enumerate(columns)))
        return (pair(a) <= pair(b)) & (pair(a) >= pair(b))

    def _beside(self) -> DataFrame:
        return self.spark.table(self.name).select(F.col("_key").alias("_k"), *(F.col(c).alias(f"_of_{c}" if c in self.by else c) for c in self.types))

    def join(self, rows: DataFrame, on: list[str] | None = None, few: bool = False) -> DataFrame:
        """rows joined with these on equal ``by`` columns, named ``on`` in rows.

        few: rows are far fewer than these, so a bucket's are held in memory and these aren't sorted.
        """
        on = on or self.by
        types = [self.types[b] for b in self.by]
        left = rows.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in on))).withColumn("_key", F.xxhash64(*(F.col(c).cast(t) for c, t in zip(on, types, strict=True))))
        left, beside = (left.hint("shuffle_hash"), self._beside()) if few else (left, self._beside().hint("merge"))
        both = left.join(beside, (F.col("_key") == F.col("_k")) & self._same([F.col(c).cast(t) for c, t in zip(on, types, strict=True)], [F.col(f"_of_{b}") for b in self.by]))
        return both.drop("_key", "_k", *(f"_of_{b}" for b in self.by))

    def fresh(self, rows: DataFrame) -> DataFrame:
        """The distinct rows whose ``by`` columns aren't there yet, dealt."""
        new = self.keyed(rows).repartition(self.n, "_key").dropDuplicates(["_key", *self.by])
        if not self.added:
            return new
        known = self._beside().hint("merge").select("_k", *(f"_of_{b}" for b in self.by))
        return new.join(known, (F.col("_key") == F.col("_k")) & self._same([F.col(b) for b in self.by], [F.col(f"_of_{b}") for b in self.by]), "left_anti")

    def unseen(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """For each ``by`` of rows the bits of words that aren't there yet, dealt; none without one. Of other columns the least."""
        others = [c for c in self.types if c not in (*self.by, *words)]
        each = lambda: [F.bit_or(w).alias(w) for w in words]
        new = self.keyed(rows).repartition(self.n, "_key").groupBy("_key", *self.by).agg(*each(), *(F.min(c).alias(c) for c in others))
        if self.added:
            of = [f"_of_{b}" for b in self.by]
            known = self._beside().groupBy("_k", *of).agg(*(F.bit_or(w).alias(f"_had{w}") for w in words)).hint("merge")
            met = new.join(known, (F.col("_key") == F.col("_k")) & self._same([F.col(b) for b in self.by], [F.col(c) for c in of]), "left")
            new = met.select("_key", *self.by, *others, *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_had{w}", F.lit(0).cast("long")))).alias(w) for w in words))
        return new.where(reduce(lambda x, y: x | y, (F.col(w) != 0 for w in words))).select(*self.types, "_key")


def dealt(df: DataFrame, by: list[str]) -> Dealt:
    return Dealt(df, by).add(df)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], rounds: int | None = None) -> DataFrame:
    """All rows that seed and step give; step(delta, all) is fed only the newest rows.

    key: the columns by which a row counts as known. There is no cap: each round finds new
    rows or is the last, so a step over a finite set of keys ends. With ``rounds`` it stops
    after so many. Known rows lie in buckets by their key and aren't shuffled again.
    """
    known = Dealt(seed, key)
    new = known.fresh(seed)
    for k in itertools.count():
        known.add(new, k)
        delta = known.rows(k)
        if delta.isEmpty() or k == rounds:
            return known.rows()
        new = known.fresh(step(delta, known.rows()))
