"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one counts how many rows set each bit of a wide filter, one bit a row, by a hash of
its digest. That filter is kept as the bits that are set, counted in each task before they
shuffle: 8 bytes for each row, whatever its text. A bit that two rows set goes into a
second filter, "possibly repeated". Pass two probes that one: a row whose bit no other row
set is unique for sure and passes straight through. Only the rest shuffle, to be grouped
by digest.

The wide filter has 64 to 128 bits a row. The second has a power of two of bits, 16 for
each repeated bit, 2**27 at most (16 MB), so it can be broadcast whatever the input. Above
8 million groups of copies it fills up: more rows take the grouped path, and results stay
exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import stash, table

WIDE_BITS_A_ROW = 64
BITS_A_KEY, MOST_BITS, BLOCK = 16, 1 << 27, 1 << 15  # a block is one bitmap of bitmap_construct_agg


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty.

    The pattern skips lone spaces, which would only be replaced by themselves.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def filter_bits(least: int) -> int:
    bits = BLOCK
    while bits < least:
        bits *= 2
    return bits


def wide_bit(sha: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(filter_bits(rows * WIDE_BITS_A_ROW)))


def _positions(wide: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(wide, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def possibly_repeated(rows: DataFrame) -> tuple[DataFrame, int]:
    """Pass one: the second filter as bitmaps (block, bits) over the bits ``wide`` that two rows or more set."""
    often = stash(rows.groupBy("wide").count().where("count > 1").select("wide"), "set-twice")
    bits = filter_bits(min(often.count() * BITS_A_KEY, MOST_BITS))
    at = often.select(F.explode(F.array(*_positions(F.col("wide"), bits))).alias("at"))
    return at.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BLOCK).alias("bitmap")), bits


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.ascii(F.decode(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.coalesce(byte.bitwiseAND(F.expr("array(1, 2, 4, 8, 16, 32, 64, 128)")[(at % 8).cast("int")]) != 0, F.lit(False))


def mark_copies(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds keep_id, group_size and kept to rows, which hold a binary column ``sha``.

    Of rows with one digest, that with the smallest id is kept. Rows repeated with the
    same id and text share the verdict of that id. A null id never wins over another;
    a group of null ids alone keeps them.
    """
    wide = wide_bit(F.col("sha"), rows.count())
    bitmaps, bits = possibly_repeated(rows.select(wide.alias("wide")))
    bitmaps = stash(bitmaps, "bloom")
    hits = []
    probed = rows
    for k, at in enumerate(_positions(wide, bits)):
        probed = probed.withColumn(f"_at{k}", at)
        side = bitmaps.select(F.col("block").alias(f"_block{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        probed = probed.join(F.broadcast(side), F.floor(F.col(f"_at{k}") / BLOCK) == F.col(f"_block{k}"), "left")
        hits.append(_bit(F.col(f"_bitmap{k}"), F.col(f"_at{k}") % BLOCK))
    probed = probed.select(*rows.columns, (hits[0] & hits[1]).alias("_maybe"))
    groups = stash(
        probed.where("_maybe").groupBy(F.col("sha").alias("_sha")).agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "copies",
    )
    out = [*rows.columns, "keep_id", "group_size"]
    grouped = probed.where("_maybe").join(groups, F.col("sha") == F.col("_sha"), "left")
    grouped = grouped.withColumns({"keep_id": F.when(F.col("_sha").isNull(), F.col(id_col)).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    alone = probed.where("not _maybe").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    return grouped.select(out).union(alone.select(out)).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are copies of each other. Other columns
    of docs aren't read, so their names can't clash. An empty table gives no rows.
    """
    rows = stash(docs.select(F.col(id_col), digest(F.col(text_col)).alias("sha")), "digests")
    return mark_copies(rows, id_col).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each normalised text: that with the smallest id; same columns.

    Of rows repeated with one id and text, or without an id, one stays, chosen by a hash
    of all its columns. They are aggregated before the shuffle, however many there are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("sha"))
    kept = mark_copies(rows, "_id").where("kept")
    alone = kept.where("group_size = 1").select("row")
    one = kept.where("group_size > 1").groupBy("sha").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return alone.union(one).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
