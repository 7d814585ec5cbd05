"""Exact top-k search by inner product, with a uniform threshold in three phases.

A score is the sum of PARTS partial scores, each over a slice of the components, so each
slice gives a local score list. Phase one gathers, per query and block of candidates, the
head of each list; the k-th best full score among these heads is a safe cutoff: k vectors
reach it. Phase two gives each query its cutoff and collects the sufficient entries: a
vector whose sum reaches the cutoff must reach cutoff / PARTS in some slice, so all others
are out. Phase three resolves the full scores of just those, exactly, and keeps the best.

Queries and candidates travel as blocks of rows packed into binary columns. The grid of
query blocks by candidate blocks is the work a stated query set needs; it is made by an
equi-join on the number of the query block, never by a product of rows. Each cell answers
with k rows a query at most, whatever ties there are, so one frequent vector does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm.common import stash, table

K, PARTS = 5, 4
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
QUERY_STEP = 50
NO_CUT = -(1 << 63)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, an array of integers; rows with unusable vectors are left out.

    A finite component that isn't a 64-bit number when multiplied is an error, as in SQL.
    """
    grown = lambda v: F.lit(256) * v.cast("double")
    fits = lambda v: F.abs(grown(v)) < F.lit(float(1 << 63))
    x = F.transform(F.col(vector_col), lambda v: F.when(fits(v), F.floor(grown(v))).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")))
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _blocks(rows: DataFrame, size: int, total: int, seed: int) -> DataFrame:
    """rows packed into about total / size blocks: block, n, width, ids, xs (bytes)."""
    count = max(1, -(-total // size))

    def packed(key, batches: Iterator):
        import pandas as pd

        pdf = pd.concat(list(batches)) if not isinstance(batches, pd.DataFrame) else batches
        pdf = pdf.sort_values("vec_id", kind="stable")
        # vectors of one width make a block of their own
        out = []
        widths = pdf["x"].map(len).to_numpy()
        for w in np.unique(widths):
            own = pdf[widths == w]
            xs = np.array(own["x"].tolist(), "<i8").reshape(len(own), int(w))
            out.append((int(key[0]), len(own), int(w), own["vec_id"].to_numpy("<i8").tobytes(), xs.tobytes()))
        return pd.DataFrame(out, columns=["block", "n", "width", "ids", "xs"])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int"))
    return keyed.groupBy("block").applyInPandas(packed, "block int, n int, width int, ids binary, xs binary")


def _unpack(ids: bytes, xs: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(xs, "<i8").reshape(n, width)


def _slices(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(PARTS, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray | list[int]:
    if scores.dtype == object:
        return sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
    return np.lexsort((ids, -scores))[:k]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=-1))


def _exact(c: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """c @ q without rounding; bound: the product of the norms, which no sum of products passes."""
    if bound < 2**52:
        return (c.astype(float) @ q.astype(float)).astype(np.int64)
    kind = np.int64 if bound < 2**62 else object
    return c.astype(np.int64).astype(kind) @ q.astype(np.int64).astype(kind)


def local_heads(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple]:
    """Phase one: full scores of the k best of each slice's list, for each query."""
    picks = []
    qf, cf = q.astype(float), c.astype(float)
    for s in _slices(q.shape[1]):
        part = qf[:, s] @ cf[:, s].T
        part[qi[:, None] == ci[None, :]] = -np.inf
        m = min(k, part.shape[1])
        picks.append(np.argpartition(-part, m - 1, axis=1)[:, :m])
    bounds = _norms(q) * _norms(c).max(initial=0)
    for r, (own, at) in enumerate(zip(qi, np.concatenate(picks, axis=1), strict=True)):
        at = np.unique(at)
        at = at[ci[at] != own]
        full = _exact(c[at], q[r], bounds[r])
        for j in _best(ci[at], full, k):
            if full[j] > NO_CUT:  # what a 64-bit cutoff can't tell gives none
                yield int(own), int(ci[at[j]]), int(full[j])


def resolved(qi: np.ndarray, q: np.ndarray, cut: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple]:
    """Phases two and three: entries that may reach the cutoff, their full scores, the best k.

    The screen is in floating point, so its threshold is lower by the most that its
    rounding can add up to.
    """
    slices = _slices(q.shape[1])
    qf, cf, nq, nc = q.astype(float), c.astype(float), _norms(q), _norms(c)
    off = (nq[:, None] * nc[None, :] * (q.shape[1] + 8) + np.abs(cut.astype(float))[:, None]) * 2.0**-51
    enough = np.broadcast_to((cut <= NO_CUT)[:, None], (len(qi), len(ci))).copy()
    for s in slices:
        enough |= qf[:, s] @ cf[:, s].T >= (cut.astype(float) / len(slices))[:, None] - off - 1e-6
    enough &= qi[:, None] != ci[None, :]
    bounds = nq * nc.max(initial=0)
    for r in range(len(qi)):
        at = np.flatnonzero(enough[r])
        full = _exact(c[at], q[r], bounds[r])
        if cut[r] > NO_CUT:
            reach = np.array([v >= int(cut[r]) for v in full], bool) if full.dtype == object else full >= cut[r]
            at, full = at[reach], full[reach]
        for j in _best(ci[at], full, k):
            yield int(qi[r]), int(ci[at[j]]), int(full[j])


ROWS = "query_id long, vec_id long, score long"


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows, ties to smaller ids.

    is_query: a condition on vec_id. Rows whose vector is null or empty, or holds nulls or
    numbers that aren't finite, take no part; vectors of another width than a query's
    have no score with it. A score in the answer that needs more than 64 bits is an error. Repeated ids are separate candidates of one id each; of
    repeated rows of a query all give the same answer, which is returned once.
    """
    import pyarrow as pa

    rows = stash(quantised(vectors, id_col, vector_col), "vectors")
    asked = rows.where(is_query).dropDuplicates(["vec_id"])
    n, m = rows.count(), asked.count()
    blocks = stash(_blocks(rows, CANDIDATE_BLOCK, n, 1), "candidates")
    queries = stash(_blocks(asked, QUERY_BLOCK, m, 2), "queries")
    count = max(1, -(-m // QUERY_BLOCK))
    right = blocks.withColumnsRenamed({x: f"c_{x}" for x in blocks.columns})
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    names = ["query_id", "vec_id", "score"]

    def rows_of(found: list[tuple]):
        cols = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    def cells(b, *more):
        get = [b.column(x).to_pylist() for x in ("ids", "xs", "n", "width", "c_ids", "c_xs", "c_n", *more)]
        for ids, xs, n, w, c_ids, c_xs, c_n, *extra in zip(*get, strict=True):
            yield (*_unpack(ids, xs, n, w), *_unpack(c_ids, c_xs, c_n, w), *extra)

    def heads(batches: Iterator) -> Iterator:
        for b in batches:
            for qi, q, ci, c in cells(b):
                yield rows_of(list(local_heads(qi, q, ci, c, k)))

    def answers(batches: Iterator) -> Iterator:
        for b in batches:
            for qi, q, ci, c, cut in cells(b, "cuts"):
                yield rows_of(list(resolved(qi, q, np.frombuffer(cut, "<i8"), ci, c, k)))

    right = right.withColumnRenamed("c_width", "width")
    parallel = max(1, -(-n // CANDIDATE_BLOCK)) * count
    grid = queries.join(right, ["block", "width"]).repartition(min(parallel, 20_000), F.rand(3))
    found = stash(grid.mapInArrow(heads, ROWS), "heads")
    # the k-th best full score so far; fewer than k: no cutoff
    worst = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    cutoffs = found.withColumn("r", worst).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cut"))
    asked = asked.select("vec_id", F.size("x").alias("width"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(count)).cast("int").alias("block"))
    own = asked.join(cutoffs, "vec_id", "left").withColumn("cut", F.coalesce("cut", F.lit(NO_CUT).cast("long")))

    def cuts(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame([(int(key[0]), int(key[1]), pdf["cut"].to_numpy("<i8").tobytes())], columns=["block", "width", "cuts"])

    cut_blocks = own.groupBy("block", "width").applyInPandas(cuts, "block int, width int, cuts binary")
    second = queries.join(stash(cut_blocks, "cutoffs"), ["block", "width"]).join(right, ["block", "width"])
    second = second.repartition(min(parallel, 20_000), F.rand(4))
    best = second.mapInArrow(answers, ROWS).withColumn("rank", worst).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
