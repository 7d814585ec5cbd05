"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Three base patterns give spans of a text: assignments to credential names, access keys and
long hexadecimal runs. What they hold, and bare tokens of credential shape, are candidates.
Each candidate's hash is counted over the whole corpus by distinct repositories and owners.
A value that many owners hold is an example that was copied around; one that few owners
hold, and that looks random, is a live credential, wherever it stands. Spans of live values
are added to the base spans: the value itself within an assignment, and its bare copies in
texts that no base pattern touches.

No UDF is used. Positions come from the pieces between matches: a match starts where the
pieces and matches before it end. Spans depend on the text and on counts by value, so all
copies of a text share them: they are worked out once for each distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import stash, table

# The base kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that fails is shorter from any later start as well
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9_-]{16,}"
LEAST_ASSIGNED, LEAST_LIVE, LEAST_DISTINCT = 6, 16, 8  # code points of a value, of a live one, and different ones in it
MOST_OWNERS = 2  # owners that may hold a live value; what more of them hold is an example
BLOCK = 256  # matches whose lengths are summed at once
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks, so that they don't cost the square of its size."""
    whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    at = lambda i: _sum(F.slice(whole, F.lit(1), F.floor(i / BLOCK).cast("int"))) + _sum(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
    return F.transform(lengths, lambda _, i: at(i))


def located(rows: DataFrame, text: str, pattern: str, group: int, name: str) -> DataFrame:
    """Adds name: start, end (code points, end exclusive) and value of each match, in order.

    Matches are leftmost and don't overlap. value: the group, by which the pattern ends.
    """
    found = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "_gaps": F.when(found, F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))).otherwise(F.array().cast("array<bigint>")),
            "_hits": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_values": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else none,
        }
    )
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("_hits", lambda h: F.length(h).cast("long")))
    rows = rows.withColumn("_steps", F.when(F.size("_hits") > 0, F.zip_with("_gaps", before, lambda g, h: g + h)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_starts", F.when(F.size("_hits") > 0, _running(F.col("_steps"))).otherwise(F.array().cast("array<bigint>")))
    value = F.transform("_hits", lambda h, i: F.get("_values", i)) if group else F.col("_hits")
    spans = F.transform("_hits", lambda h, i: F.struct(F.get("_starts", i).alias("start"), (F.get("_starts", i) + F.length(h)).alias("end"), F.get(value, i).alias("value")))
    return rows.withColumn(name, spans.cast(SPAN)).drop("_gaps", "_hits", "_values", "_steps", "_starts")


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, and enough different ones."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.length(value) >= LEAST_LIVE) & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def base_spans(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """One row per row of docs: id, owner, repository, text_key, assign, access, hex (spans), candidates.

    text_key is the text's digest, null where there is no candidate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("_repository"), text.alias("_text"))
    for pattern, group, name in ((ASSIGN, 2, "assign"), (ACCESS, 0, "access"), (HEX, 0, "hex"), (BARE, 0, "bare")):
        rows = located(rows, "_text", pattern, group, name)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= LEAST_ASSIGNED))
    values = F.transform("assign", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)
    rows = rows.withColumn("candidates", F.filter(F.array_distinct(F.concat(values, "access", "hex", "bare")), lambda s: looks_live(s["value"])))
    hashed = F.transform("candidates", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    kept = rows.withColumns({"candidates": hashed, "text_key": F.when(F.size("candidates") > 0, F.sha2("_text", 256))})
    bare_of = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(c)
    return kept.select(F.col("_id").alias(id_col), "_owner", "_repository", "text_key", *map(bare_of, KINDS[:3]), "candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, n_documents; candidates: hash, owner, repository, a row each.

    Counted by owner and repository first, so a value that fills the corpus is no one's burden.
    """
    places = candidates.groupBy("hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_documents"))


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row of docs: id, assign, access, hex, live (arrays of start and end).

    live: spans of values that look random and that at most most_owners owners hold in the
    whole corpus. Null text counts as empty; a null owner or repository counts as one of its
    own; rows that share an id or a text each keep their row; an empty table gives no rows.
    Other columns of docs aren't read, so their names can't clash.
    """
    rows = stash(base_spans(docs, id_col, text_col, owner, repository), "secrets")
    some = rows.where("text_key is not null")
    each = some.select("_owner", "_repository", F.explode(F.array_distinct(F.transform("candidates", lambda c: c["hash"]))).alias("hash"))
    held = ownership(each).where(F.col("n_owners") <= most_owners).select(F.col("hash").alias("_hash"))
    at = some.groupBy("text_key").agg(F.first("candidates").alias("candidates")).select("text_key", F.explode("candidates").alias("c"))
    live = at.select("text_key", "c.*").join(held, F.col("hash") == F.col("_hash"), "left_semi")
    live = live.groupBy(F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("live"))
    out = [id_col, *KINDS]
    marked = some.join(live, F.col("text_key") == F.col("_key"), "left").withColumn("live", F.coalesce("live", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    plain = rows.where("text_key is null").withColumn("live", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return marked.select(out).union(plain.select(out))


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans in these columns by start, then kind, joined by commas."""

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")))

    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(tagged, range(len(kinds)), kinds))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner, and each language of a source is a repository."""
    found = scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *sizes[:3], F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"), sizes[3])


def _sql_spans(name: str, pattern: str, group: int, most: str = "true") -> str:
    """Matches of a pattern with their places: the pieces before a match and the matches before it."""
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', {group})" if group else "h"
    return f"""{name} AS (SELECT r, start, start + length(h) AS "end", v FROM (
        SELECT r, unnest(h) AS h, unnest(v) AS v, unnest(range(1, len(h) + 1)) AS i, g, h AS hs FROM (SELECT r, h, {value} AS v, string_split_regex(t, '{p}') AS g FROM (SELECT r, t, regexp_extract_all(t, '{p}', 0) AS h FROM d) WHERE len(h) > 0)
    ), LATERAL (SELECT CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start) WHERE {most})"""


_ANY_CASE = ASSIGN.replace("(?i)", "").replace("password|passwd|secret|token|api_?key", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS o, coalesce(source || '/' || lang, source, lang, '') AS p, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
{_sql_spans("a", _ANY_CASE, 2, f"length(v) >= {LEAST_ASSIGNED}")}, {_sql_spans("k", ACCESS, 0)}, {_sql_spans("x", HEX, 0)}, {_sql_spans("b", BARE, 0)},
c AS (SELECT DISTINCT * FROM (SELECT r, "end" - length(v) AS start, "end", v FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM x UNION ALL SELECT * FROM b)
    WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND length(v) >= {LEAST_LIVE} AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT}),
l AS (SELECT * FROM c WHERE v IN (SELECT v FROM c JOIN d USING (r) GROUP BY v HAVING count(DISTINCT o) <= {MOST_OWNERS})),
s AS (SELECT r, start, "end", 0 AS kind FROM a UNION ALL SELECT r, start, "end", 1 FROM k UNION ALL SELECT r, start, "end", 2 FROM x UNION ALL SELECT r, start, "end", 3 FROM l),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
    string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans,
    string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (kind < 3) AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n3, 0) AS n_live
FROM d LEFT JOIN g USING (r)
"""
