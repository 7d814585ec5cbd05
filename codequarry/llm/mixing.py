"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a share of the mix; text is taken in blocks of equal numbers of words.
Blocks go to sources, and within a source to shards (seeded hash ranges of its
documents), by highest quotients votes / (2 seats + 1). That gives each shard a whole
number of blocks. The shard's documents, in seeded order, are one row of words cut into
blocks; every block is taken as often as the quota goes round, and a seeded choice of
them once more. A quota never goes round more than twice.

Only totals by shard come to the driver: a shard holds 2**20 words and more, so there
are few. Seats are found by bisecting the divisor, not by handing out one at a time.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm.common import gives_back, small_batches, stash, table

BLOCK, SHARD_WORDS, MOST_SHARDS, SEED = 64, 1 << 20, 100_000, 7
WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Whole seats by highest quotients; none gets over ``most``. Ties: first in order."""
    votes = votes.astype(float)
    seats = min(seats, int(most.sum()))
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * (most.max() + 1) + 1), 4 * votes.max()  # too many seats, none
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = at(high)
    while (left := seats - int(out.sum())) > 0:  # equal quotients at the divisor
        quotient = np.where(out < most, votes / (2 * out + 1), -1)
        out[np.argsort(-quotient, kind="stable")[:left]] += 1
    return out


def targets(sizes: list[int]) -> list[float]:
    """Words that each source should give, sources in their order."""
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]
    goal, free, out = SHARE * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = max(goal, 0.0) / sum(weights[k] for k in free)
        over = {k for k in free if weights[k] * unit > CEILING * sizes[k]}
        for k in over or free:
            out[k] = float(CEILING * sizes[k]) if over else weights[k] * unit
        if not over:
            break
        goal -= sum(CEILING * sizes[k] for k in over)
        free -= over
    return out


def _quotas(shards: pd.DataFrame, seed: int) -> pd.DataFrame:
    """For each shard: its source's size and target, blocks, quota, and the seeded choice.

    shards: source (null last), shard, words; sorted.
    """
    known = sorted(shards.itertuples(index=False), key=lambda r: (r.source is None, r.source or "", r.shard))
    sources = [(name, list(own)) for name, own in itertools.groupby(known, key=lambda r: r.source)]
    sizes = [sum(int(r.words) for r in own) for _, own in sources]
    goal = targets(sizes)
    seats = sainte_lague(np.array(goal), round(sum(goal) / BLOCK), np.array([math.floor(CEILING * s / BLOCK) + 1 for s in sizes]))
    rows = []
    for (name, own), size, target, quota in zip(sources, sizes, goal, seats, strict=True):
        words = np.array([r.words for r in own], np.int64)
        blocks = -(-words // BLOCK)
        for s, n, q in zip(own, blocks.tolist(), sainte_lague(words, int(quota), CEILING * blocks).tolist(), strict=True):
            rng = np.random.default_rng([seed, len(rows)])
            step = int(rng.integers(1, max(2, n)))
            while n > 1 and math.gcd(step, n) != 1:
                step += 1
            rows.append((name, int(s.shard), size, target, int(n), q, step % max(n, 1), int(rng.integers(0, max(1, n)))))
    return pd.DataFrame(rows, columns=["source", "shard", "source_size", "target", "blocks", "quota", "step", "shift"])


QUOTAS = "source string, shard int, source_size long, target double, blocks long, quota long, step long, shift long"


def words_in(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def placed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, the place of its words in its shard (first), and the shard's quota."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = stash(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cell = max(SHARD_WORDS, total // MOST_SHARDS)
    own = rows.groupBy("source").agg(F.sum("size").alias("_words"))
    own = own.select(F.col("source").alias("_source"), F.greatest(F.lit(1), F.ceil(F.col("_words") / cell)).alias("_shards"))
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("_source")))
    place = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.select("doc_id", "source", "size", place.alias("place"), F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "_shards").cast("int").alias("shard"))
    quotas = _quotas(rows.groupBy("source", "shard").agg(F.sum("size").alias("words")).toPandas(), seed)
    plan = spark.createDataFrame(quotas.astype(object).where(quotas.notna(), None).values.tolist(), QUOTAS)
    before = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    plan = plan.withColumnsRenamed({"source": "_source", "shard": "_shard"})
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard", "place", "shard")


def mix(docs: DataFrame, seed: int = SEED, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size: words between ASCII white space, 0 for null and empty texts, which are never
    taken. Rows of one id lie side by side in the seeded order, by size. Columns besides
    id, text and source aren't read. An empty table gives no rows.
    """
    end = F.col("first") + F.col("size")

    def words(b: Column) -> Column:
        held = F.least(end, (b + 1) * BLOCK) - F.greatest(F.col("first"), b * BLOCK)
        again = F.pmod(b * F.col("step") + F.col("shift"), F.col("blocks")) < F.pmod(F.col("quota"), F.col("blocks"))
        return held * (F.floor(F.col("quota") / F.col("blocks")) + again.cast("long"))

    spans = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((end - 1) / BLOCK))
    taken = F.when(F.col("size") > 0, F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + words(b))).otherwise(F.lit(0).cast("long"))
    return placed(docs, seed, **columns).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def excerpt(text: str, first: int, size: int, blocks: int, quota: int, step: int, shift: int) -> list[str]:
    """What the mix takes of a text: whole copies, and the words of the blocks taken once more."""
    if not size or not blocks:
        return []
    out = [text] * (quota // blocks)
    rest = quota % blocks
    chosen = [b for b in range(first // BLOCK, (first + size - 1) // BLOCK + 1) if (b * step + shift) % blocks < rest]
    if len(chosen) == (first + size - 1) // BLOCK - first // BLOCK + 1:
        return [*out, text]
    if chosen:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        cuts = [(max(first, b * BLOCK) - first, min(first + size, (b + 1) * BLOCK) - first) for b in chosen]
        out.append("\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in cuts))
    return out


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: docs (doc_id, text, source, n_chars and more) as often as they are
    taken, whole or in excerpts; same columns, n_chars counted anew."""
    small_batches(docs.sparkSession)
    names = docs.columns
    own = F.struct("first", "size", "blocks", "quota", "step", "shift")
    plan = placed(docs, seed).groupBy("doc_id", "size").agg(F.min(own).alias("plan"))  # rows of one id and size share the first's
    row = F.struct(*docs.columns).alias("row")  # one column, so that no name of docs can clash
    rows = docs.select(row, F.col("doc_id").alias("row_id"), words_in(F.col("text")).alias("row_size"))
    joined = rows.join(plan, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_size") == F.col("size")))
    at, chars = names.index("text"), names.index("n_chars")

    def takes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = pa.RecordBatch.from_arrays(b.column(0).flatten(), names=names)
            got = [excerpt(t or "", **p) for t, p in zip(rows.column(at).to_pylist(), b.column(1).to_pylist(), strict=True)]
            rows = rows.take(pa.array([i for i, g in enumerate(got) for _ in g], pa.int64()))
            texts = [t for g in got for t in g]
            columns = list(rows.columns)
            columns[at], columns[chars] = pa.array(texts, pa.string()), pa.array([len(t) for t in texts], rows.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("row", "plan").mapInArrow(gives_back(takes), docs.schema)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
