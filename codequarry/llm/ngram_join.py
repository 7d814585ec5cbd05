"""N-gram Jaccard join with signature trees: near-duplicates by sets of word shingles.

Documents with equal sets are one class, whose key is a 64-bit hash of its set, so ids that
repeat with other texts don't get in the way. Only a class's first document goes on. Then:

1. Sampling. Each class posts its shingles of small hash, about POSTED of them, or all of
   a small set. A class links with another only if most of its shingles are shared, so
   one that shares too few of the sampled ones with any other class is done. "Too few"
   is exact where all sets that may link are posted whole; else it is judged on the
   shingles that each of them would post, and the odds of dropping a link are below
   2**-64 (Chernoff's bound for sampling without replacement), as small as those of two
   different shingles having one 64-bit hash.
2. Blocks. What is left is grouped so that linked classes share a block: within a size
   range, each class is tied by its rarest sampled shingles (prefix filter, same odds),
   and tied classes are one connected block. Common passages are the last in that order.
3. Trees. A block's full sets, each sent once, form a tree: a node holds the OR of its
   members' bitmaps, their range of sizes and the most shingles that share a bit. A dual
   traversal from the root prunes node pairs whose greatest possible overlap is too
   small; pairs of leaves are settled on the sets. A block of over BLOCK_ROWS classes, or
   over BLOCK_SHINGLES shingles in all, is dealt into parts by hash, and each pair of
   parts is a task, so that long texts fill no task's memory either.

A task answers with a spanning forest of its links, so copies and clusters give rows in
proportion to their members, never all pairs. Components of these links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import gives_back, small_batches, stash, table
from codequarry.llm.components import components

N, SHARE = 5, (75, 100)
POSTED = 128
BLOCK_ROWS, BLOCK_SHINGLES, FANOUT = 1024, 4_000_000, 8  # a part of a block: sets, and shingles (8 bytes each) in all
GROUP_BYTES = 500_000  # of text hashed at a time; the work arrays take some 60 bytes for each
MOST_BROADCAST = 2_000_000  # ids
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C55
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles for many texts at a time, all in array operations."""

    def __init__(self, n: int = N):
        self.n = n
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 2 * GROUP_BYTES)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word of data, and a hash of each word."""
        raw = np.frombuffer(data, np.uint8)
        self._grow(len(raw) + 1)
        inside = np.concatenate(([False], ~_SPACE[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64)))
        return starts, _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The sorted set of each text; empty if it has no words."""
        group: list[bytes] = []
        size = 0
        for t in texts:
            group.append(t.encode().lower())
            size += len(group[-1]) + 1
            if size > GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[bytes]) -> Iterator[np.ndarray]:
        if not group:
            return
        with np.errstate(over="ignore"):
            starts, words = self._words(b"\n".join(group))
            firsts = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
            cut = np.searchsorted(starts, firsts).tolist()
            n = self.n
            whole = np.full(max(0, len(words) - n + 1), n, np.uint64)
            for k in range(n):
                whole = whole + words[k : k + len(whole)] * _STEP[k % len(_STEP)]
            whole = _mix(whole)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a >= n:
                    yield np.unique(whole[a : b - n + 1])
                elif b > a:
                    yield _mix(np.array([b - a], np.uint64) + (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def least_common(t: int, whole: bool) -> int:
    """Of t sampled shingles of a set, how many a linked set has at least.

    whole: the sample is the set itself. Else the odds of fewer are below 2**-64.
    """
    p = SHARE[0] / SHARE[1]
    if whole:
        return -(-t * SHARE[0] // SHARE[1])
    low = 0
    for c in range(1, t):
        a = c / t
        if a >= p or t * (a * math.log(a / p) + (1 - a) * math.log((1 - a) / (1 - p))) < 65 * math.log(2):
            break
        low = c
    return low


def _needed(t: Column, whole: Column) -> Column:
    """least_common as a column, 1 at least."""
    most = 4 * POSTED
    tables = [F.array(*[F.lit(max(1, least_common(k, w))) for k in range(most + 1)]) for w in (True, False)]
    at = F.least(t, F.lit(most)).cast("int") + 1
    return F.when(whole, F.element_at(tables[0], at)).otherwise(F.element_at(tables[1], at))


def _fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    """Two sums over a set's hashes, and the key of its class."""
    with np.errstate(over="ignore"):
        fa, fb = (_mix(s ^ _STEP[k]).sum(dtype=np.uint64) for k in (0, 1))
        key = _mix(_mix(np.array([fa]) + np.uint64(len(s))) ^ fb)
    return tuple(int(x) for x in np.array([fa, fb, key[0]], np.uint64).view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, fa and fb (a fingerprint of the set), key, posted (its shingles of small hash)."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            n, prints, posted = [], [], []
            for s in shingler.sets([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(s))
                prints.append(_fingerprint(s))
                posted.append((s if len(s) <= POSTED else s[: np.searchsorted(s, np.uint64(2**64 // len(s) * POSTED))]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in posted]))), pa.int32()), pa.array(np.concatenate(posted) if posted else np.zeros(0, np.int64)))
            columns = [pa.array([x[k] for x in prints], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *columns, lists], names=["doc_id", "n", "fa", "fb", "key", "posted"])

    small_batches(docs.sparkSession)
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(gives_back(rows), "doc_id long, n long, fa long, fb long, key long, posted array<long>")


def _below(token: Column, size: Column, part: float) -> Column:
    """Whether an unsigned hash is under part / size of its range."""
    unit = (F.shiftrightunsigned(token, 11)).cast("double") / F.lit(float(1 << 53))
    return unit * size < part


def candidates(classes: DataFrame) -> DataFrame:
    """Step 1: classes that share enough sampled shingles, with those shingles (key, n, token)."""
    posts = classes.where("n > 0").select("key", "n", F.explode("posted").alias("token"))
    common = stash(posts.groupBy("token").count().where("count > 1").select(F.col("token").alias("_token")), "common")
    hits = stash(posts.join(common, F.col("token") == F.col("_token")).drop("_token"), "hits")
    # a linked set has n / 0.75 shingles at most: all of them are posted whole, or else each posts those under 0.75 * POSTED / n
    whole = F.col("n") * SHARE[1] <= POSTED * SHARE[0]
    tested = F.when(whole, F.size("posted")).otherwise(F.size(F.filter("posted", lambda x: _below(x, F.col("n"), 0.75 * POSTED))))
    need = classes.select(F.col("key").alias("_id"), _needed(tested, whole).alias("_need"))
    inside = whole | _below(F.col("token"), F.col("n"), 0.75 * POSTED)
    shared = hits.where(inside).groupBy("key").agg(F.count(F.lit(1)).alias("_shared"))
    left = stash(shared.join(need, F.col("key") == F.col("_id")).where("_shared >= _need").select(F.col("key").alias("_id")), "left")
    return stash(hits.join(left, F.col("key") == F.col("_id")).drop("_id"), "left-hits")


def blocks(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 2: key, n and block of each class that may link with another."""
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9).cast("int")
    runs = hits.withColumn("run", F.explode(F.array(own, own + 1)))
    bound = F.pow(F.lit(4 / 3), F.col("run") + 1)
    runs = runs.where((bound <= POSTED) | _below(F.col("token"), bound, POSTED))
    often = stash(runs.groupBy("run", "token").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("lead")).where("df > 1"), "often")
    tied = runs.join(often, ["run", "token"])
    # tokens of a class that no other has are the rarest: they take places in its prefix
    size = classes.select(F.col("key").alias("_id"), "posted")
    per = tied.groupBy("key", "n", "run").agg(F.sort_array(F.collect_list(F.struct("df", "token", "lead"))).alias("shared"))  # POSTED or so at most
    per = per.join(size, F.col("key") == F.col("_id"))
    tested = F.when(bound <= POSTED, F.size("posted")).otherwise(F.size(F.filter("posted", lambda x: _below(x, bound, POSTED))))
    per = per.withColumn("t", tested)
    prefix = F.col("t") - _needed(F.col("t"), bound <= POSTED) + 1 - (F.col("t") - F.size("shared"))
    edges = per.where(prefix > 0).select(F.col("key").alias("a"), F.explode(F.slice("shared", F.lit(1), F.least(prefix, F.size("shared")).cast("int"))).alias("s"))
    found = components(edges.select("a", F.col("s.lead").alias("b")))
    found = found.select(F.col("node").alias("_id"), F.col("component").alias("block"))
    return found.join(classes.select("key", "n"), F.col("key") == F.col("_id")).select("key", "n", "block")


class Tree:
    """A signature tree over sets: levels of (OR bitmaps, least size, most size, most crowding)."""

    def __init__(self, sets: list[np.ndarray], words: int):
        sizes = np.array([len(s) for s in sets])
        heads = np.array([s[0] for s in sets])
        self.order = np.lexsort((heads, np.floor(np.log(sizes) / math.log(4 / 3))))
        bits = np.zeros((len(sets), words), np.uint64)
        for r, i in enumerate(self.order):
            at = sets[i] % np.uint64(64 * words)
            np.bitwise_or.at(bits[r], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        sizes = sizes[self.order]
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1))]
        while len(self.levels[-1][0]) > 1:
            b, low, high, crowd = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(crowd, at)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some member of node i of level a may link with one of node j of level b."""
    common = np.empty(len(i), np.int64)
    for k in range(0, len(i), 4096):
        s = slice(k, k + 4096)
        common[s] = np.bitwise_count(a[0][i[s]] & b[0][j[s]]).sum(axis=1)
    most = common + np.minimum(a[3][i], b[3][j])
    need = np.maximum(a[1][i], b[1][j])  # a linked set shares 75 % of the larger set at least
    fits = (SHARE[1] * a[2][i] >= SHARE[0] * b[1][j]) & (SHARE[1] * b[2][j] >= SHARE[0] * a[1][i])
    return fits & (SHARE[1] * most >= SHARE[0] * need)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)


def forest(ids: list[int], sets: list[np.ndarray], split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, as (id, smallest id of its component).

    split: only links between the first ``split`` sets and the others.
    """
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    parts = [sets] if split is None else [sets[:split], sets[split:]]
    if all(parts) and len(sets) > 1:
        words = 1 << max(2, (min(1 << 16, 4 * max(map(len, sets))) - 1).bit_length() - 6)
        trees = [Tree(p, words) for p in parts]
        a, b = trees[0], trees[-1]
        top = max(len(a.levels), len(b.levels)) - 1
        i = j = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
            keep = _possible(la, lb, i, j)
            i, j = i[keep], j[keep]
            if not level:
                break
            kids = []
            for tree, at in ((a, i), (b, j)):
                if level >= len(tree.levels):
                    kids.append((at, np.ones(len(at), np.int64)))
                else:
                    n = len(tree.levels[level - 1][0])
                    kids.append((at * FANOUT, np.minimum(FANOUT, n - at * FANOUT)))
            (fi, ni), (fj, nj) = kids
            total = ni * nj
            rep = np.repeat(np.arange(len(i)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i, j = fi[rep] + k // nj[rep], fj[rep] + k % nj[rep]
            if split is None:
                once = i <= j
                i, j = i[once], j[once]
        shift = 0 if split is None else split
        left, right = a.order[i], b.order[j] + shift
        for p in np.argsort(np.abs(i - j) if split is None else np.zeros(len(i)), kind="stable").tolist():
            x, y = int(left[p]), int(right[p])
            if x != y and (u := root(x)) != (v := root(y)) and linked(sets[x], sets[y]):
                parent[max(u, v)] = min(u, v)
    least: dict[int, int] = {}
    for k, own in enumerate(ids):
        r = root(k)
        least[r] = min(own, least.get(r, own))
    return [(own, least[root(k)]) for k, own in enumerate(ids) if least[root(k)] != own]


def links(docs: DataFrame, placed: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Step 3: a spanning forest (a, b) of the links within blocks.

    placed: key, doc_id, n, block; repeated: keys of classes whose document has more rows than one.
    """
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = stash(placed.groupBy(F.col("block").alias("_block")).agg(parts.alias("parts")), "blocks")
    placed = stash(placed.join(sizes, F.col("block") == F.col("_block")).drop("_block"), "placed")
    # ids alone are broadcast, and only while they are few; else the texts are shuffled
    side = placed.select(F.col("doc_id").alias("_id"), "key", "block", "parts")
    side = F.broadcast(side) if placed.count() <= MOST_BROADCAST else side
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(side, F.col("doc_id") == F.col("_id"))

    def sets(batches: Iterator) -> Iterator:
        """The full sets; of an id's texts, those of the class that is asked for."""
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            found = list(shingler.sets([t or "" for t in b.column(3).to_pylist()]))
            at = pa.array([k for k, (s, key) in enumerate(zip(found, b.column(0).to_pylist(), strict=True)) if _fingerprint(s)[2] == key], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:3]), pa.array([found[k].tobytes() for k in at.to_pylist()], pa.binary())], names=["key", "block", "parts", "members"])

    rows = rows.select("key", "block", "parts", "text").mapInArrow(gives_back(sets), "key long, block long, parts int, members binary")
    if not repeated.isEmpty():  # one row of each class, before rows of a block come together
        again = rows.join(repeated, "key", "left_semi").groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("block", "parts", "members")])
        rows = rows.join(repeated, "key", "left_anti").union(again)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "key", "members")

    def tree(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["part", "key"])
        members = [np.frombuffer(m, np.uint64) for m in pdf["members"]]
        split = None if key[1] == key[2] else int((pdf["part"] == key[1]).sum())
        return pd.DataFrame(forest(pdf["key"].tolist(), members, split), columns=["a", "b"])

    return cells.groupBy("block", "p", "q").applyInPandas(tree, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Null, empty and blank texts have an empty set and are alone; so is a row without an
    id, whose component is null. Documents with equal sets are linked. Rows of one id are
    one document: it links with whatever any of its texts links with, and its rows are in
    one component. Other columns of docs aren't read.
    """
    own = stash(sketches(docs, id_col, text_col), "sketches")
    some = own.where("n > 0 and doc_id is not null")
    classes = stash(some.groupBy("fa", "fb", "n", "key").agg(F.min("doc_id").alias("doc_id"), F.any_value("posted").alias("posted")), "classes")
    nodes = classes.select("key", "n", "posted")
    placed = stash(blocks(candidates(nodes), nodes).join(classes.select(F.col("key").alias("_key"), "doc_id"), F.col("key") == F.col("_key")).drop("_key"), "in-blocks")
    # ids with more rows than one: of one class, or of several, which are tied by the id then
    rows = stash(some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")).where("rows > 1"), "repeated-ids")
    many = some.join(rows, "doc_id")
    ties = many.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    repeated = many.select("key").distinct()
    found = stash(components(links(docs, placed, repeated, id_col, text_col).union(ties)), "components")
    grouped = classes.select("key", "doc_id").join(found.select(F.col("node").alias("_node"), "component"), F.col("key") == F.col("_node"), "left")
    grouped = stash(grouped.select("key", "doc_id", F.coalesce("component", "key").alias("component")), "grouped")
    least = grouped.groupBy(F.col("component").alias("_component")).agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, F.col("component") == F.col("_component")).select(F.col("key").alias("_key"), "component_id")
    joined = own.drop("posted").join(stash(named, "named"), F.col("key") == F.col("_key"), "left")
    linked_ = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked_, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
