"""Packing documents into sequences: cutting stock by column generation.

A document of more than a sequence gives full sequences first; what remains is an item.
Items are counted in classes of eight tokens. The linear program "fewest sequences that
hold all items" runs over patterns (how many items of each class share a sequence); a
knapsack dynamic programme prices new patterns from the duals until none improves.
Patterns are used a whole number of times (rounded down), and what they leave over is
packed by first fit decreasing over the classes, not over documents. Only the histogram
comes to the driver: 512 classes by a bounded number of salts. Documents are ranked
within class and salt, and each rank has its place in a pattern.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm.common import gives_back, small_batches, stash, table
from codequarry.llm.tokens import END_ID, encoder, tokenizer_path

LENGTH, GRAIN = 4096, 8
GAP = 2e-4  # stop when the linear program is this near to its bound
MOST_PRICINGS = 3000
MOST_SALTS, ROWS_A_SALT = 1024, 100_000


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within room, and how many of each."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if k := upto[w]:
            got = best[w - sizes[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[w] + 1e-12:
                best[w], took[w] = got[i], i
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            counts[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), counts


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, fractions allowed."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse, used = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(MOST_PRICINGS):
        duals = inverse.sum(axis=0)
        value, column = knapsack(np.maximum(duals, 0), sizes, room)
        if value <= 1 + 1e-9 or used.sum() * (1 - 1 / value) <= GAP * used.sum():
            break
        along = inverse @ column
        ratio = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * along, 0)
        used[out] = step
        basis[:, out] = column
        pivot = inverse[out] / along[out]
        inverse -= np.outer(along, pivot)
        inverse[out] = pivot
    return basis.astype(np.int64).reshape(m, m), used


def first_fit(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[dict[int, int]]:
    """Patterns (class index -> count), each used once, for a bounded rest of items."""
    bins: list[dict[int, int]] = []
    by_room: dict[int, list[int]] = {}
    for k in np.argsort(-sizes):
        size = int(sizes[k])
        for _ in range(int(demand[k])):
            left = next((r for r in range(size, room + 1) if by_room.get(r)), None)
            if left is None:
                bins.append({})
                at, left = len(bins) - 1, room
            else:
                at = by_room[left].pop()
            bins[at][int(k)] = bins[at].get(int(k), 0) + 1
            by_room.setdefault(left - size, []).append(at)
    return bins


def plan(sizes: np.ndarray, demand: np.ndarray, room: int = LENGTH // GRAIN) -> list[tuple[dict[int, int], int]]:
    """Patterns (class index -> count) and whole numbers of uses that hold all items."""
    if not len(sizes):
        return []
    columns, used = linear_program(sizes, demand, room)
    whole = np.floor(used + 1e-6).astype(np.int64)
    out, rest = [], demand.copy()
    for k in np.flatnonzero(whole):
        out.append(({int(i): int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}, int(whole[k])))
        rest -= columns[:, k] * whole[k]
    return out + [(p, 1) for p in first_fit(sizes, np.maximum(rest, 0), room)]


class Places:
    """Where the item of rank r in a class goes: sequence, and order in the sequence."""

    def __init__(self, sizes: np.ndarray, patterns: list[tuple[dict[int, int], int]], first: int):
        rows: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
        for pattern, uses in patterns:
            for k, count in pattern.items():
                rows[int(sizes[k])].append((uses * count, count, first))
            first += uses
        self.by_class = {}
        for size, found in rows.items():
            held, count, base = np.array(found, np.int64).reshape(-1, 3).T
            self.by_class[size] = (np.cumsum(held) - held, count, base)

    def of(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lows, counts, bases = self.by_class[size]
        k = np.searchsorted(lows, rank, side="right") - 1
        q = rank - lows[k]
        return bases[k] + q // counts[k], (LENGTH - size) * LENGTH + q % counts[k]


PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, lead: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: as many full sequences as it fills, and the rest.

    Null text counts as empty: one piece with the end id. Other columns aren't read.
    """

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = encoder(path, lead), np.uint32(end_id).tobytes()
        for b in batches:
            out: list[tuple] = []
            for i, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids = memoryview(x + end)
                n = len(ids) // 4
                out += [(i, n, s, min(LENGTH, n - s), zlib.crc32(ids[4 * s : 4 * (s + LENGTH)])) for s in range(0, n, LENGTH)]
            if out:
                names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(gives_back(pieces), PIECES)


def assign(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are a stored table.

    Rows of one document id with one start (repeated rows) are ranked by checksum, and
    equal ones in any order: they may swap places.
    """
    spark = pieces.sparkSession
    items = pieces.withColumn("size", F.ceil(F.col("length") / GRAIN).cast("int"))
    salts = max(16, min(MOST_SALTS, -(-pieces.count() // ROWS_A_SALT)))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = items.groupBy("size", "salt").count().toPandas()  # 512 classes by 1,024 salts at most
    table_ = np.zeros((LENGTH // GRAIN + 1, salts), np.int64)
    table_[counts["size"].to_numpy(int), counts["salt"].to_numpy(int)] = counts["count"]
    bases, totals = np.cumsum(table_, axis=1) - table_, table_.sum(axis=1)
    top = LENGTH // GRAIN
    full, sizes = int(totals[top]), np.flatnonzero(totals[:top])
    places = Places(sizes, plan(sizes, totals[sizes]), full)
    shared = spark.sparkContext.broadcast((bases, places.by_class))

    def place(batches: Iterator) -> Iterator:
        bases, by_class = shared.value
        own = Places.__new__(Places)
        own.by_class = by_class
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy(np.int64) - 1
            rank = rank + bases[size, pdf["salt"].to_numpy()]
            sequence, order = rank.copy(), np.zeros(len(rank), np.int64)
            for s in np.unique(size[size < top]):
                at = size == s
                sequence[at], order[at] = own.of(int(s), rank[at])
            yield pdf.drop(columns=["size", "rank", "salt"]).assign(sequence_id=sequence, order=order)

    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")))
    placed = ranked.mapInPandas(place, f"{PIECES}, sequence_id long, order long")
    before = W.partitionBy("sequence_id").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("order")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all docs with their sequence and offset; see the module's text."""
    out = assign(stash(cut(docs, path), "pieces"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
