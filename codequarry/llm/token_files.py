"""Token ids as directly addressable codes, in binary segments.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every token;
a continuation bitmap says which tokens go on; level 1 holds the next chunk of just
those, and so on. A rank directory gives the number of set bits before each block of
512, so token i is found by one rank for each level: no block is decoded.

A segment, all numbers little-endian:
  magic b"DAC1", levels u32, documents u64, tokens u64,
  doc_ids i64[documents], starts u64[documents + 1] (in tokens, from the segment's start),
  then for each level: count u64, chunks u8[count], and but for the last level the
  bitmap u8[ceil(count / 8)] (lowest bit first) and directory u32[ceil(count / 512)].
Segments are rows of a table (part, seq, payload), written and read by Spark, so that
any storage that Spark knows will do. Order: part, seq; parts are ranges of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm.common import gives_back, small_batches, stash, table, width
from codequarry.llm.tokens import END_ID, encoder, tokenizer_path

MAGIC, RANK_BLOCK, SEGMENT_TOKENS = b"DAC1", 512, 1 << 20
SEGMENTS = "part int, seq int, documents long, tokens long, payload binary"
NO_ID = -(1 << 63)  # stands for a null doc_id


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; ids: those of all documents, one after the other."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> 8
        on = more > 0
        levels.append(((rest & 255).astype(np.uint8), on))
        if not on.any():
            break
        rest = more[on]
    out = [MAGIC, np.uint32(len(levels)).tobytes(), np.array([len(doc_ids), len(ids)], "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()]
    for k, (chunks, on) in enumerate(levels):
        out += [np.uint64(len(chunks)).tobytes(), _pad(chunks.tobytes())]
        if k < len(levels) - 1:
            counts = np.add.reduceat(on, np.arange(0, len(on), RANK_BLOCK), dtype=np.int64)
            out += [_pad(np.packbits(on, bitorder="little").tobytes()), _pad((np.cumsum(counts) - counts).astype("<u4").tobytes())]
    return b"".join(out)


class Segment:
    """Reads a segment; ``token(i)`` takes one token without decoding others."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        docs, self.tokens = map(int, np.frombuffer(data, "<u8", 2, 8))
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for k in range(levels):
            count = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(data, np.uint8, count, at)
            at += -(-count // 8) * 8
            bits = ranks = None
            if k < levels - 1:
                bits = np.frombuffer(data, np.uint8, -(-count // 8), at)
                at += -(-len(bits) // 8) * 8
                ranks = np.frombuffer(data, "<u4", -(-count // RANK_BLOCK), at)
                at += -(-4 * len(ranks) // 8) * 8
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BLOCK * RANK_BLOCK
            i = int(ranks[i // RANK_BLOCK]) + int(np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first].sum())
        return value

    def all(self) -> np.ndarray:
        values = self.levels[-1][0].astype(np.uint32)
        for chunks, bits, _ in self.levels[-2::-1]:
            low = chunks.astype(np.uint32)
            low[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= values << 8
            values = low
        return values


def write_tokens(docs: DataFrame, path: str, lead: bool, end_id: int = END_ID, label: str = "tokens", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write segments in ascending order of id, and return their table.

    Null text counts as empty and holds the end id alone; rows with one id are ordered
    by their text, null ids come first. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    part = F.spark_partition_id()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(width(docs.sparkSession), "i").sortWithinPartitions("i", "t").withColumn("part", part)

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end, seq, where = encoder(path, lead), np.uint32(end_id).tobytes(), 0, 0
        held_ids, held, size = [], [], 0

        def flush():
            data = pack_segment(np.array(held_ids, np.int64), np.array([len(x) // 4 for x in held]), np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([where], pa.int32()), "seq": pa.array([seq], pa.int32()), "documents": pa.array([len(held)], pa.int64()), "tokens": pa.array([size], pa.int64()), "payload": pa.array([data], pa.binary())})

        for b in batches:
            if not b.num_rows:
                continue
            where = b.column("part")[0].as_py()
            for i, x in zip(b.column("i").to_pylist(), enc.encode(b.column("t").to_pylist()), strict=True):
                held_ids.append(i)
                held.append(x + end)
                size += len(x) // 4 + 1
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    held_ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    return stash(rows.mapInArrow(gives_back(segments), SEGMENTS), label)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the segments."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row for a million tokens
    starts = segments.select("part", "seq", "tokens").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).drop("tokens")

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for base, data in zip(b.column("base").to_pylist(), b.column("payload"), strict=True):
                s = Segment(data.as_buffer())
                ids = memoryview(s.all().astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), "start": pa.array(s.starts[:-1] + base), "n_tokens": pa.array(np.diff(s.starts)), "ids_crc32": pa.array(crc, pa.int64())})

    joined = segments.select("part", "seq", "payload").join(starts, ["part", "seq"]).select("base", "payload")
    return joined.mapInArrow(gives_back(documents), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), lead=True))
