"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: each word of a piece with the words that lead it on,
padded past the piece's end. Every shorter phrase is a prefix of these windows, so Spark's
ROLLUP over the window columns sums them all, down to the number of words of a language;
no n-grams of other lengths are made.

Most windows are rare, and a phrase that occurs too seldom is neither a candidate nor a part
of one. A first pass hashes each prefix of each window into a fixed number of counters,
merged over all tasks. Where a counter stays under the least number, no prefix that falls
into it occurs often enough, and the window is cut before its last word: what is cut off
could only count towards phrases that are too rare. Results are the same with any number of
counters, but full ones cut nothing. A task's own array of counters is bounded, so on larger inputs,
which would fill it, tasks give on what they counted by ranges of counters instead: a range is
summed in one task, and counters stay as many as the input needs. Only a bit for each group of them
is sent to tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.llm.common import gives_back, small_batches, stash, table, width

LONGEST, LEAST, BEST, MOST_INSIDE = 3, 10, 2000, 50  # words, occurrences, phrases of a language, percent
SCALE = 1_000_000
PAD = ""
LEAST_BITS, MOST_BITS, BLOCK_BITS = 18, 26, 14  # powers of two: counters of a task, and those of a block
FINER_BITS, RANGE_BITS, MOST_MARKS = 4, 24, 28  # powers of two: counters of a range for each one wanted, in a range at most, marks sent to tasks
HELD_WORDS, HELD_PLACES = 300_000, 2_000_000  # words that a task numbers, and places, before it gives its windows on
PARTS = 64  # buckets of a language's ranking
_PIECE, _WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


class Held:
    """The words of some texts as one row of numbers, pieces apart by -1."""

    def __init__(self):
        self.names: list[tuple[str, str]] = []  # language and word
        self.numbers: dict[str, dict[str, int]] = {}
        self.row: list[int] = []

    def add(self, lang: str, text: str | None) -> None:
        own = self.numbers.get(lang)
        if own is None:
            own = self.numbers[lang] = {PAD: len(self.names)}
            self.names.append((lang, PAD))
        for piece in _PIECE.split((text or "").encode("utf-8", "replace").lower().decode()):
            if words := _WORD.findall(piece):
                for w in words:
                    k = own.get(w)
                    if k is None:
                        k = own[w] = len(self.names)
                        self.names.append((lang, w))
                    self.row.append(k)
                self.row.append(-1)

    def windows(self, longest: int) -> np.ndarray:
        """Each word with those that lead it on, -1 past the piece's end."""
        row = np.array(self.row + [-1] * longest, np.int64)
        columns = [row[: len(self.row)]]
        for k in range(1, longest):
            columns.append(np.where(columns[-1] < 0, -1, row[k : k + len(self.row)]))
        out = np.stack(columns, axis=1) if self.row else np.zeros((0, longest), np.int64)
        return out[out[:, 0] >= 0]

    def pads(self) -> np.ndarray:
        """For each word the padding of its language."""
        return np.array([self.numbers[lang][PAD] for lang, _ in self.names], np.int64)

    def hashes(self) -> np.ndarray:
        return np.array([zlib.crc32(f"{lang}\n{w}".encode("utf-8", "replace")) for lang, w in self.names], np.uint64)


def longer(prefixes: np.ndarray | None, words: np.ndarray) -> np.ndarray:
    """The hash of each prefix (None: the empty one) with one more word, from the word's hash."""
    with np.errstate(over="ignore"):
        mixed = words * np.uint64(0xC2B2AE3D27D4EB4F) + (np.uint64(0) if prefixes is None else prefixes * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def _held_texts(batches: Iterator) -> Iterator[Held]:
    held = Held()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.add(lang, text)
            if len(held.names) > HELD_WORDS or len(held.row) > HELD_PLACES:
                yield held
                held = Held()
    yield held


def _distinct(windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of windows (-1 to most - 2), and how often each occurs."""
    bits = most.bit_length()
    if bits * windows.shape[1] > 62:
        return np.unique(windows, axis=0, return_counts=True)
    shifts = [bits * k for k in range(windows.shape[1])]
    keys, sizes = np.unique(sum((windows[:, k] + 1) << s for k, s in enumerate(shifts)), return_counts=True)
    return np.stack([((keys >> s) & ((1 << bits) - 1)) - 1 for s in shifts], axis=1), sizes


def frequent_prefixes(rows: DataFrame, longest: int, least: int, bits: int) -> bytes:
    """A bit for each counter: whether so many prefixes of windows, or more, fell into it.

    rows: lang, text. A task counts into one array, up to ``least``; arrays travel as packed
    blocks, and blocks of one number are added up where they meet.
    """
    block, blocks = 1 << min(BLOCK_BITS, bits), 1 << max(0, bits - BLOCK_BITS)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << bits, np.uint8)
        for held in _held_texts(batches):
            slots, n = np.unique(_prefix_hashes(held, longest) >> np.uint64(64 - bits), return_counts=True)
            total[slots] = np.minimum(total[slots] + np.minimum(n, least), least)
        some = [k for k in range(blocks) if total[k * block : (k + 1) * block].any()]
        for j in range(0, len(some), 64):
            packed = [zlib.compress(total[k * block : (k + 1) * block].tobytes(), 1) for k in some[j : j + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(some[j : j + 64], pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def merged(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(packed), np.uint8)
                sums[k] = np.minimum(sums[k] + more, least).astype(np.uint8) if k in sums else more
        marks = [np.packbits(v >= least).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(marks, pa.binary())], names=["block", "marks"])

    small_batches(rows.sparkSession)
    n = min(blocks, max(1, width(rows.sparkSession)))
    arrays = stash(rows.mapInArrow(gives_back(counted), "block int, counts binary"), "prefix-counters")
    marks = arrays.repartition(n, "block").mapInArrow(gives_back(merged), "block int, marks binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in marks.collect():  # 2**MOST_BITS bits at most: 8 MB
        got = np.frombuffer(bytes(r["marks"]), np.uint8)
        out[r["block"] * len(got) : (r["block"] + 1) * len(got)] = got
    return out.tobytes()


def _prefix_hashes(held: Held, longest: int) -> np.ndarray:
    """The hash of each prefix of each window."""
    windows, hashes = held.windows(longest), held.hashes()
    found, prefixes = [], None
    for k in range(longest):
        there = windows[:, k] >= 0
        windows = windows[there]
        prefixes = longer(None if prefixes is None else prefixes[there], hashes[windows[:, k]])
        found.append(prefixes)
    return np.concatenate(found)


def frequent_ranges(rows: DataFrame, longest: int, least: int, fine: int, bits: int) -> bytes:
    """As frequent_prefixes, with 2**fine counters; a bit for each 2**(fine - bits) of them: whether one has so many.

    A task gives on only the counters that it met, dealt by range; no task holds more than a range.
    """
    span = min(RANGE_BITS, fine)
    span = min(span, fine - bits + 20)  # 2**20 marks of a range at most
    wide = np.uint32 if span > 16 else np.uint16

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for held in _held_texts(batches):
            slots, n = np.unique(_prefix_hashes(held, longest) >> np.uint64(64 - fine), return_counts=True)
            n, ranges = np.minimum(n, least).astype(np.uint8), slots >> np.uint64(span)
            slots = (slots & np.uint64((1 << span) - 1)).astype(wide)
            firsts = np.flatnonzero(np.diff(ranges, prepend=np.uint64(1 << 63)))
            ends = [*firsts[1:], len(ranges)]
            for j in range(0, len(firsts), 64):
                some = [*zip(firsts[j : j + 64], ends[j : j + 64], strict=True)]
                columns = [pa.array([int(ranges[a]) for a, _ in some], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (slots, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "slots", "counts"])

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def marked() -> pa.RecordBatch:
            often = np.packbits((total >= least).reshape(-1, 1 << (fine - bits)).any(axis=1)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([often], pa.binary())], names=["part", "marks"])

        now, total = None, np.zeros(1 << span, np.uint8)
        for b in batches:  # sorted by range
            for part, slots, counts in zip(*b.columns, strict=True):
                if part.as_py() != now:
                    if now is not None:
                        yield marked()
                    now, total = part.as_py(), np.zeros(1 << span, np.uint8)
                at = np.frombuffer(slots.as_buffer(), wide)
                total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), least)
        if now is not None:
            yield marked()

    small_batches(rows.sparkSession)
    n = max(1, min(1 << (fine - span), width(rows.sparkSession)))
    met = rows.mapInArrow(gives_back(counted), "part int, slots binary, counts binary")
    marks = met.repartition(n, "part").sortWithinPartitions("part").mapInArrow(gives_back(summed), "part int, marks binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in marks.collect():  # 2**MOST_MARKS bits at most: 32 MB
        got = np.frombuffer(bytes(r["marks"]), np.uint8)
        out[r["part"] * len(got) : (r["part"] + 1) * len(got)] = got
    return out.tobytes()


def counted_windows(rows: DataFrame, longest: int, marks: bytes | None, bits: int) -> DataFrame:
    """lang, w1 to w<longest>, n: the windows of each task, counted.

    A window is padded past the end of its piece, and from the word on with which the counters
    show it to be rare; one that begins with a rare word is all padding, and counts only
    towards the number of words.
    """
    names = ["lang", *(f"w{k + 1}" for k in range(longest)), "n"]
    sent = rows.sparkSession.sparkContext.broadcast(marks) if marks is not None else None

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        often = np.frombuffer(sent.value, np.uint8) if sent is not None else None
        for held in _held_texts(batches):
            windows, hashes = held.windows(longest), held.hashes()
            if often is not None:
                there, prefixes = np.arange(len(windows)), None
                for k in range(longest):
                    inside = windows[there, k] >= 0
                    there, prefixes = there[inside], None if prefixes is None else prefixes[inside]
                    prefixes = longer(prefixes, hashes[windows[there, k]])
                    slots = (prefixes >> np.uint64(64 - bits)).astype(np.int64)
                    good = (often[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0
                    rare = there[~good]
                    pads = held.pads()[windows[rare, 0]]
                    windows[rare, k:] = -1
                    if k == 0:
                        windows[rare, 0] = pads
                    there, prefixes = there[good], prefixes[good]
            some, sizes = _distinct(windows, len(held.names) + 1)
            words = pa.array([w for _, w in held.names] + [PAD], pa.string())
            langs = pa.array([x for x, _ in held.names], pa.string())
            for j in range(0, len(some), 50_000):
                now = some[j : j + 50_000]
                columns = [langs.take(pa.array(now[:, 0])), *(words.take(pa.array(np.where(now[:, k] < 0, len(held.names), now[:, k]))) for k in range(longest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[j : j + 50_000], pa.int64())], names=names)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(gives_back(counted), ", ".join([f"{c} string" for c in names[:-1]]) + ", n long")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """lang, size, phrase, f for phrases of 1 to ``longest`` words that occur ``least`` times;
    size 0 (phrase "") is the number of all words of a language.

    bits: 2**bits counters; 0: none, so that all windows travel whole; None: by the
    number of characters, held by tasks up to 2**MOST_BITS and by ranges beyond.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    if by_size := bits is None:
        characters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(LEAST_BITS, (characters // 25).bit_length())
    if by_size and bits > MOST_BITS:
        fine, bits = min(40, bits + FINER_BITS), min(MOST_MARKS, bits)
        marks = frequent_ranges(rows, longest, least, fine, bits)
    else:
        marks = frequent_prefixes(rows, longest, least, bits) if bits else None
    words = [f"w{k + 1}" for k in range(longest)]
    top = counted_windows(rows, longest, marks, bits).groupBy("lang", *words).agg(F.sum("n").alias("n"))
    sums = top.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # of each level the words that it goes by; a pad is no word, and a rolled-up column is null
    size = F.lit(longest) - F.bit_count("level")
    last = F.coalesce(*reversed(words), F.lit("-"))
    kept = sums.where(F.col("lang").isNotNull()).withColumn("size", size).where((last != PAD) & ((F.col("size") == 0) | (F.col("f") >= least)))
    return stash(kept.select("lang", "size", F.concat_ws(" ", *words).alias("phrase"), "f"), "phrases")


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10**6 a² / (l r)); exact for numbers under 10**15, in decimals of 38 places."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(l) * wide(r))


def _part(first: Column | int, last: Column) -> Column:
    return F.array_join(F.slice("words", first, last), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, best: int = BEST, most_inside: int = MOST_INSIDE, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    A phrase's score is that of its weakest cut, 10**6 a² / (l r), l and r being the numbers of its
    two parts; all in decimals, so products don't overflow. Phrases that lie within a longer one
    with ``most_inside`` percent of their occurrences are dropped. Null text counts as empty, a
    null language as "und", repeated rows count again; an empty table gives no rows. Other
    columns of docs aren't read, so their names can't clash.
    """
    counts = phrase_counts(docs, lang_col, text_col, longest, least, bits)
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("_first"), _part(F.col("k") + 1, F.size("words")).alias("_rest"))
    part = lambda name, f: counts.where("size > 0").select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(f))
    cuts = cuts.join(part("_l", "l"), (F.col("lang") == F.col("_l_lang")) & (F.col("_first") == F.col("_l_phrase")))
    cuts = cuts.join(part("_r", "r"), (F.col("lang") == F.col("_r_lang")) & (F.col("_rest") == F.col("_r_phrase")))
    weakest = cuts.select("lang", "phrase", "a", F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    longer = phrases.where("size > 2").select("lang", F.col("a").alias("_more"), "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_n"))
    longer = longer.select("lang", "_more", "words", "_n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)).alias("_from"))
    inside = longer.groupBy(F.col("lang").alias("_lang"), _part(F.col("_from"), F.col("_n")).alias("_phrase")).agg(F.max("_more").alias("_more"))
    kept = weakest.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").where(F.coalesce(100 * F.col("_more") < most_inside * F.col("a"), F.lit(True)))

    # a language may hold nearly all phrases: the best of each bucket first, then the best of those
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("_bucket", bucket).withColumn("_place", F.row_number().over(W.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_place") <= best)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    sizes = counts.where("size = 0").select(F.col("lang").alias("_of"), F.col("f").alias("n"))
    return ranked.join(sizes, F.col("lang") == F.col("_of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, id, unnest(w) AS w1, unnest(range(len(w))) AS i FROM (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)),
g AS (SELECT lang, w1, w1 || ' ' || lead(w1) OVER v AS w2, w1 || ' ' || lead(w1) OVER v || ' ' || lead(w1, 2) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL UNION ALL SELECT lang, 2, w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 3, w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
e AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
cut AS (SELECT k.lang, k.phrase, k.a, l.f AS l, r.f AS r, k, (1000000::HUGEINT * k.a * k.a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN e l ON l.lang = k.lang AND l.phrase = k.x JOIN e r ON r.lang = k.lang AND r.phrase = k.y),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, x AS phrase, max(a) AS more FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS x FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN t USING (lang, phrase) WHERE more IS NULL OR 100 * more < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
