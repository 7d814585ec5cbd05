"""Retrieval of similar examples by vectors, and pooling of token vectors."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions.columns import cosine, dot


GROUP_VECTORS = 4_096  # candidates that a task scores at a time, with all queries that meet them
GROUP_QUERIES = 16_384  # queries that such a task holds at a time
NEARLY = 1e-5  # scores are rounded to 1e-6, so that nothing below the k-th by more than this can count


def _leaders(queries: DataFrame, vectors: DataFrame, on: list[str], k: int) -> DataFrame:
    """qid, id: what may be among the k most similar of each query, of all that meet on equal keys.

    Equal vectors score the same, so of those only the k first by id count. A group's vectors are dealt into
    parts of about GROUP_VECTORS, its queries into blocks of about GROUP_QUERIES, and all parts meet all blocks. Each
    is scored by matrix products; of each query it gives on what comes near its own k-th score or above,
    and what has no finite score. The same rule over all parts leaves few pairs for the exact formula.
    """
    queries = queries.select(*on, "qid", "qvec")
    first = F.dense_rank().over(W.partitionBy(*on, "vec").orderBy("id"))
    vectors = vectors.select(*on, "id", "vec").withColumn("_first", first).where(F.col("_first") <= k).drop("_first")
    counted = lambda rows, most, name: rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = counted(vectors, GROUP_VECTORS, "_parts").join(counted(queries, GROUP_QUERIES, "_blocks"), on)
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    rows = vectors.join(sizes, on).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).withColumn("_block", each("_blocks"))
    asked = queries.join(sizes, on).withColumn("_block", F.pmod(F.xxhash64("qid"), F.col("_blocks")).cast("int")).withColumn("_part", each("_parts"))

    def best(asked_rows, rows_):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def unit(column):
            """Vectors of length one as rows; nan where one is null, shorter or holds a null."""
            lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
            sizes = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            values = lists.flatten()
            if lists.null_count == 0 and values.null_count == 0 and len(sizes) == 1:
                out = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            else:
                each = lists.to_pylist()
                out = np.full((len(each), max((len(v) for v in each if v is not None), default=0)), np.nan)
                for i, v in enumerate(each):
                    if v is not None:
                        out[i, : len(v)] = v
            return out / np.sqrt((out * out).sum(axis=1))[:, None]

        with np.errstate(all="ignore"):
            q, v = unit(asked_rows.column("qvec")), unit(rows_.column("vec"))
            found: list = [[np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]]
            for first in range(0, len(q), 1_024):
                some = q[first : first + 1_024]
                score = some @ v.T if q.shape[1] == v.shape[1] else np.full((len(some), len(v)), np.nan)
                odd = ~np.isfinite(score)
                low = np.where(odd, -np.inf, score)
                least = np.partition(low, -k, axis=1)[:, -k] if k < low.shape[1] else np.full(len(low), -np.inf)
                a, b = np.nonzero(odd | (low >= least[:, None] - NEARLY))
                for out, part in zip(found, (a + first, b, score[a, b]), strict=True):
                    out.append(part)
        a, b, near = map(np.concatenate, found)
        near = pa.array(near, pa.float64(), mask=~np.isfinite(near))
        return pa.table([asked_rows.column("qid").take(pa.array(a)), rows_.column("id").take(pa.array(b)), near], names=["qid", "id", "near"])

    types = dict([*queries.select("qid").dtypes, *vectors.select("id").dtypes])
    left = asked.select(*[F.col(c).alias(f"_{c}") for c in on], "_part", "_block", "qid", "qvec").groupBy(*[f"_{c}" for c in on], "_part", "_block")
    met = left.cogroup(rows.select(*on, "_part", "_block", "id", "vec").groupBy(*on, "_part", "_block"))
    met = met.applyInArrow(best, f"qid {types['qid']}, id {types['id']}, near double")
    pairs = met.groupBy("qid", "id").agg(F.max("near").alias("near"), F.max(F.col("near").isNull()).alias("odd"))
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("near")))
    least = F.min(F.when(F.col("_r") <= k, F.col("near"))).over(W.partitionBy("qid"))
    rows = pairs.withColumn("_r", order).withColumn("_least", least)
    return rows.where((F.col("_r") <= k) | F.col("odd") | (F.col("near") >= F.col("_least") - NEARLY)).select("qid", "id")


def _placed(queries: DataFrame, vectors: DataFrame, leaders: DataFrame, key: str, k: int, once: bool) -> DataFrame:
    """qid, id, score, place: the k best of each query by the exact formula, of leaders (qid, id)."""
    c = F.col
    asked, given = queries.select("qid", "qvec", c(key).alias("_key")), vectors.select("id", "vec", c(key).alias("_of"))
    met = leaders.select(c("qid").alias("_q"), c("id").alias("_i")).join(asked, c("_q").eqNullSafe(c("qid")))
    met = met.join(given, c("_i").eqNullSafe(c("id")) & (c("_key") == c("_of")))
    rows = met.select("qid", "id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))
    rows = rows.distinct() if once else rows
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def top_k_examples(queries: DataFrame, vectors: DataFrame, k: int, key: str | None = "rule") -> DataFrame:
    """qid, id, score, place: the k vectors most similar to each query, of the same key.

    Candidates meet by the key first, so scoring never sees other rules' vectors, and a hot key is
    dealt into parts. Scores are rounded, so that ties break by id in every engine.
    """
    if k <= 0:
        return queries.select("qid").limit(0).selectExpr("qid", "cast(null as bigint) id", "cast(null as double) score", "cast(null as int) place")
    if key is None:
        queries, vectors = queries.withColumn("_one", F.lit(0)), vectors.withColumn("_one", F.lit(0))
    key = key or "_one"
    return _placed(queries, vectors, _leaders(queries, vectors, [key], k), key, k, False)


def _margins(vec: Column, planes: list[list[float]]) -> Column:
    """How far a vector lies to one side of each plane."""
    return F.array(*[dot(vec, F.array(*map(F.lit, p))) for p in planes])


def _side(margins: Column) -> Column:
    """The bucket: a bit for each plane, set where the vector lies on its positive side."""
    return F.aggregate(margins, F.lit(0).cast("long"), lambda b, m: b * 2 + F.when(m > 0, 1).otherwise(0))


class Hyperplanes:
    """Buckets of vectors by random hyperplanes, in several tables of planes.

    Vectors of a small angle mostly lie on the same sides. bits: planes of a table; a table
    has 2**bits buckets for each key. The same seed gives the same planes anywhere.
    """

    def __init__(self, dim: int, bits: int = 6, tables: int = 6, seed: int = 1):
        rng = random.Random(seed)
        self.bits, self.tables = bits, [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]

    def index(self, vectors: DataFrame) -> DataFrame:
        """vectors with table and bucket, a row for each table; written once, it serves all queries."""
        places = [F.struct(F.lit(t).alias("table"), _side(_margins(F.col("vec"), planes)).alias("bucket")) for t, planes in enumerate(self.tables)]
        return vectors.withColumn("_at", F.explode(F.array(*places))).select(*vectors.columns, "_at.table", "_at.bucket")

    def probes(self, queries: DataFrame, near: int) -> DataFrame:
        """queries with table and bucket: the own one, and those across each set of the ``near`` nearest planes."""
        own = [F.struct(F.lit(t).alias("table"), _margins(F.col("qvec"), planes).alias("margins")) for t, planes in enumerate(self.tables)]
        rows = queries.withColumn("_t", F.explode(F.array(*own)))
        order = F.slice(F.array_sort(F.transform("_t.margins", lambda m, i: F.struct(F.abs(m).alias("far"), i.alias("at")))), 1, near)
        rows = rows.withColumns({"_near": order, "_own": _side(F.col("_t.margins"))})
        weight = F.transform("_near", lambda p: F.pow(F.lit(2.0), F.lit(self.bits - 1) - p["at"]).cast("long"))
        # each subset of the near planes flips their bits
        flips = F.aggregate(weight, F.array(F.lit(0).cast("long")), lambda sets, w: F.concat(sets, F.transform(sets, lambda x: x + w)))
        rows = rows.withColumn("bucket", F.explode(F.transform(flips, lambda f: F.col("_own").bitwiseXOR(f))))
        return rows.select(*queries.columns, "_t.table", "bucket")


def top_k_approximate(queries: DataFrame, index: DataFrame, planes: Hyperplanes, k: int, key: str | None = "rule", near: int = 4) -> DataFrame:
    """As top_k_examples, but only vectors that share a probed bucket are scored.

    index: planes.index(vectors). Scores of what is found are exact; some of the k may be
    missed, see recall. Rows of one id and key count as one vector. With ``near`` as large as ``planes.bits`` all are found.
    """
    if k <= 0:
        return top_k_examples(queries, index, k)
    if key is None:
        queries, index = queries.withColumn("_one", F.lit(0)), index.withColumn("_one", F.lit(0))
    key = key or "_one"
    leaders = _leaders(planes.probes(queries, near), index, ["table", "bucket", key], k)
    return _placed(queries, index.where("table = 0"), leaders, key, k, True)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, recall: the share of each query's exact results (qid, id) that was found."""
    hits = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def rank_contexts(pairs: DataFrame) -> DataFrame:
    """Context vectors of each finding (qid, qvec, id, vec) ranked by similarity."""
    rows = pairs.select("qid", "id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))


def number_examples(scored: DataFrame) -> DataFrame:
    return scored.withColumn("number", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))


def pool_embedding(tokens: DataFrame, mode: str = "mean", size: int | None = None) -> DataFrame:
    """doc, vec: the mean of a document's token vectors (doc, pos, vec), or the first.

    Null vectors and components aren't counted. With ``size`` a mean has so many components, null
    where no vector has one; otherwise as many as the longest vector.
    """
    if mode == "first":
        return tokens.groupBy("doc").agg(F.min_by("vec", "pos").alias("vec"))
    parts = tokens.select("doc", F.posexplode_outer("vec").alias("dim", "x")).groupBy("doc", "dim").agg(F.avg("x").alias("x"))
    means = F.array_sort(F.filter(F.collect_list(F.struct("dim", "x")), lambda s: s["dim"].isNotNull()))
    if size is None:
        return parts.groupBy("doc").agg(F.transform(means, lambda s: s["x"]).alias("vec"))
    rows = parts.groupBy("doc").agg(F.map_from_entries(means).alias("_means"))
    return rows.select("doc", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("_means", i)).alias("vec"))


def embed(rows: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """rows with embedding; the encoder is made once in each task and takes batches. Other columns stay in Arrow."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = make_encoder()
        for b in batches:
            made = pa.array(encoder(b.column(b.schema.get_field_index(text_col)).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "embedding"])

    return rows.mapInArrow(encode, T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
