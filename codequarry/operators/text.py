"""Projections, filters and text transforms over files, lines, findings and replies."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.columns import brace_balance, lines_of, ordered_text

COMMENT = "//"
FENCE = "```"
RULE_PREFIX = "@performance/"
BRACKETS = {"(": ")", "[": "]", "{": "}"}


def explode_lines(files: DataFrame, key: str = "path") -> DataFrame:
    """Lines (key, line_no from 1, text) of files (key, content); no shuffle."""
    return files.select(key, F.posexplode(lines_of(F.col("content"))).alias("p", "text")).select(key, (F.col("p") + 1).alias("line_no"), "text")


def curate(files: DataFrame, test_suffix: str = ".test.ets") -> DataFrame:
    return files.where(~F.col("path").endswith(test_suffix) & (F.col("content") != ""))


def parse_rule_pages(files: DataFrame) -> DataFrame:
    """stem, description (leading comment lines) and example (the rest), each on one line."""
    ls = F.transform(lines_of(F.col("content")), lambda x: F.trim(x))
    first = F.array_position(F.transform(ls, lambda x: ~x.startswith(COMMENT)), True)
    rows = files.withColumn("_ls", ls).withColumn("_n", F.when(first > 0, first - 1).otherwise(F.size(ls)).cast("int"))
    head = F.transform(F.slice("_ls", F.lit(1), F.col("_n")), lambda x: F.trim(F.substring(x, len(COMMENT) + 1, 1 << 30)))
    rest = F.slice("_ls", F.col("_n") + 1, F.greatest(F.size("_ls") - F.col("_n"), F.lit(0)))
    return rows.select("stem", F.array_join(head, " ").alias("description"), F.array_join(rest, " ").alias("example"))


def flatten_example(content: Column) -> Column:
    return F.array_join(F.transform(lines_of(content), lambda x: F.trim(x)), " ")


def stem(path: Column) -> Column:
    """The file's name without folder and last extension."""
    return F.regexp_extract(path, r"([^/\\]+)\.[^./\\]+$", 1)


def rule_key(path: Column) -> Column:
    return F.concat(F.lit(RULE_PREFIX), F.trim(stem(path)))


def project_of(path: Column, rnd: Column) -> Column:
    """The folder after origin/ (round 0), round_N_reject/ or round_N/; else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    names = F.when(rnd == 0, "origin").otherwise(F.concat(F.lit("round_"), rnd.cast("string"), F.lit("(?:_reject)?")))
    found = F.call_function("regexp_extract", p, F.concat(F.lit("(?:^|/)"), names, F.lit("/([^/]+)/")), F.lit(1))
    return F.when(found != "", found)


def relative_from(rows: DataFrame, part: str = "ets") -> DataFrame:
    """rows with relative: the path from the first part of that name on; others rejected."""
    parts = F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(parts, part).cast("int")
    return rows.withColumn("_at", at).where("_at > 0").withColumn("relative", F.array_join(F.slice(parts, F.col("_at"), F.size(parts)), "/")).drop("_at")


def line_snippet(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Each finding's own line, trimmed; empty past the end of the file."""
    at = lines.select("path", F.col("line_no").alias("line"), F.trim("text").alias("_t"))
    return findings.join(at, ["path", "line"], "left").withColumn("snippet", F.coalesce("_t", F.lit(""))).drop("_t")


def statement_snippet(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """From the finding's line to the first line that ends a statement.

    Lines are numbered by the statement they belong to, so the join is on equal keys.
    """
    t = F.trim("text")
    ends = t.rlike(r"[{;)\"']$") | t.startswith("@") | t.startswith("private")
    before = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    parts = lines.select("path", "line_no", t.alias("t"), F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).alias("part"))
    own = findings.join(parts.select("path", F.col("line_no").alias("line"), "part"), ["path", "line"])
    found = own.join(parts, ["path", "part"]).where("line_no >= line")
    return found.groupBy("path", "line", "rule").agg(ordered_text("line_no", "t", "").alias("snippet"))


def identifiers_at(text: Column) -> Column:
    """Names in decorator or let form; where there are none, names used as this.x."""
    declared = F.concat(F.regexp_extract_all(text, F.lit(r"@\w+\s+(\w+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"let\s+(\w+)\s*="), F.lit(1)))
    return F.when(F.size(declared) > 0, declared).otherwise(F.regexp_extract_all(text, F.lit(r"this\.(\w+)"), F.lit(1)))


def fenced_json(replies: DataFrame) -> DataFrame:
    """payload: the text if it is JSON, else its first fenced json; valid; value (a variant)."""
    whole = F.try_parse_json("text").isNotNull()
    fence = F.regexp_extract("text", rf"{FENCE}json\s*([\s\S]*?){FENCE}", 1)
    payload = F.when(whole, F.col("text")).when(F.col("text").contains(f"{FENCE}json"), F.trim(F.regexp_replace(fence, r"^\n+|\n+$", "")))
    rows = replies.withColumn("payload", payload)
    return rows.withColumns({"value": F.try_parse_json("payload"), "valid": F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False))})


def fix_pair(replies: DataFrame) -> DataFrame:
    """problem_code and problem_fix from the first json fence, closed or not; null if bad."""
    body = F.regexp_extract("text", rf"{FENCE}json\s*([\s\S]*?)(?:{FENCE}|\z)", 1)
    pair = F.from_json(body, "problem_code string, problem_fix string")
    return replies.withColumn("_p", pair).withColumns({"problem_code": F.col("_p.problem_code"), "problem_fix": F.col("_p.problem_fix")}).drop("_p")


def code_block(text: Column) -> Column:
    """What stands between the first fence of a known language and the last fence."""
    found = F.regexp_extract(text, rf"{FENCE}(?:typescript|javascript|arkts|ets|ts|js)\n([\s\S]*){FENCE}", 1)
    return F.when(found == "", text).otherwise(found)


def all_code_blocks(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"{FENCE}\w*\n([\s\S]*?){FENCE}"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(text)


def apply_diff_markers(text: Column) -> Column:
    kept = F.filter(lines_of(text), lambda x: ~x.startswith("-"))
    return F.array_join(F.transform(kept, lambda x: F.when(x.startswith("+"), F.substring(x, 2, 1 << 30)).otherwise(x)), "\n")


def line_diff(pairs: DataFrame, a: str, b: str, key: str = "key") -> DataFrame:
    """Lines that one text holds more often than the other: key, mark, text, times."""

    def side(column: str, name: str) -> DataFrame:
        ls = pairs.select(key, F.explode(lines_of(F.col(column))).alias("text")).where(F.trim("text") != "")
        return ls.groupBy(key, "text").agg(F.count(F.lit(1)).alias(name))

    both = side(a, "na").join(side(b, "nb"), [key, "text"], "full").fillna(0, ["na", "nb"]).where("na <> nb")
    return both.select(key, F.when(F.col("nb") > F.col("na"), "+").otherwise("-").alias("mark"), "text", F.abs(F.col("nb") - F.col("na")).alias("times"))


def line_diff_text(pairs: DataFrame, a: str, b: str, key: str = "key") -> DataFrame:
    """The ordered form: one text a pair, lines marked by + - and blank."""

    def diffs(batches: Iterator) -> Iterator:
        import difflib

        for pdf in batches:
            texts = [[[x for x in t.split("\n") if x.strip()] for t in pdf[c]] for c in ("a", "b")]
            out = ["\n".join(x for x in difflib.ndiff(p, q) if x[:1] != "?") for p, q in zip(*texts, strict=True)]
            yield pdf[["key"]].assign(diff=out)

    return pairs.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(diffs, "key string, diff string")


def bracket_report(lines: DataFrame) -> DataFrame:
    """Brackets that are extra, mismatched or unclosed: path, line_no, k, bracket, problem.

    Windows stand for the stack: the running balance less its lowest value is the depth;
    within one depth brackets alternate, so a bracket's neighbour there is its partner.
    """
    text = F.when(F.ltrim("text").startswith("}") & F.col("text").contains(".tabBar"), F.regexp_replace("text", r"^\s*\}", "")).otherwise(F.col("text"))
    rows = lines.select("path", "line_no", F.posexplode(F.regexp_extract_all(text, F.lit(r"[(){}\[\]]"), F.lit(0))).alias("k", "bracket"))
    order = W.partitionBy("path").orderBy("line_no", "k")
    opens = F.col("bracket").isin(*BRACKETS)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum(F.when(opens, 1).otherwise(-1)).over(upto))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("cum").over(upto)))
    rows = rows.withColumn("extra", F.col("floor") < F.coalesce(F.lag("floor").over(order), F.lit(0)))
    rows = rows.withColumn("level", F.when(F.col("extra"), F.lit(-1)).otherwise(F.col("cum") - F.col("floor") + (~opens).cast("int")))
    same = W.partitionBy("path", "level").orderBy("line_no", "k")
    partner = F.lag("bracket").over(same)
    closes = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])[partner]
    rows = rows.withColumns({"wrong": ~opens & (closes != F.col("bracket")), "last": F.lead("bracket").over(same).isNull()})
    problem = F.when(F.col("extra"), "extra").when(~opens & F.col("wrong"), "mismatched").when(opens & F.col("last"), "unclosed")
    return rows.withColumn("problem", problem).where("problem is not null").select("path", "line_no", "k", "bracket", "problem")


def tokenize(files: DataFrame) -> DataFrame:
    """Tokens (path, start, end, text, line) of files; blanks are left out."""
    pattern = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\n|[ \t\r]+|[\s\S]"
    rows = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("k", "text"))
    before = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0).cast("long"))
    line = F.coalesce(F.sum((F.col("text") == "\n").cast("int")).over(before), F.lit(0)) + 1
    rows = rows.select("path", start.alias("start"), (start + F.length("text")).alias("end"), "text", line.alias("line"))
    return rows.where(F.col("text").rlike(r"^[^\s]"))


def split_call_path(s: Column) -> Column:
    """The three parts of a.b.c(); an empty array for anything else."""
    part = [F.regexp_extract(s, r"^(\w+)\.(\w+)\.(\w+)\(\)$", k) for k in (1, 2, 3)]
    return F.when(part[0] != "", F.array(*part)).otherwise(F.array().cast("array<string>"))


def last_bracket(s: Column) -> Column:
    """What the last <...()> at the end holds; empty if there is none."""
    return F.trim(F.regexp_extract(s, r"<([^<>]*)\(\)>$", 1))


def guess_line_span(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """First line that contains a label's first line, last that contains its last; else 1."""
    rows = labels.join(lines, "path", "left")
    first = F.min(F.when(F.contains("text", "label_first"), F.col("line_no")))
    last = F.max(F.when(F.contains("text", "label_last"), F.col("line_no")))
    return rows.groupBy("path", "label").agg(F.coalesce(first, F.lit(1)).alias("start_line"), F.coalesce(last, F.lit(1)).alias("end_line"))


#: Bits of the modifiers.
MODIFIERS = {name: 1 << k for k, name in enumerate("private protected public export static abstract async const accessor default in readonly out override declare".split())}


def has_modifier(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(MODIFIERS[name])) != 0


POSITION_BITS, POSITION_MOST = 16, (1 << 16) - 1


def pack_position(line: Column, col: Column) -> Column:
    """Line and column in one int of 32 bits, each held to 0 ... 65535."""
    held = [F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(POSITION_MOST)) for x in (line, col)]
    return F.shiftleft(held[0], POSITION_BITS).bitwiseOR(held[1])


def unpack_position(packed: Column) -> tuple[Column, Column]:
    """Line and column; -1 for one that isn't set."""
    parts = F.shiftrightunsigned(packed, POSITION_BITS), packed.bitwiseAND(POSITION_MOST)
    return tuple(F.when(x == 0, -1).otherwise(x) for x in parts)


def content_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def filter_entry_methods(methods: DataFrame, names: DataFrame) -> DataFrame:
    """Methods whose name is in the list of lifecycle and callback names (name)."""
    return methods.join(names, "name", "left_semi")


def strip_temp_locals(locals_: DataFrame) -> DataFrame:
    return locals_.where((F.col("name") != "this") & ~F.col("name").startswith("$"))


def with_balance(lines: DataFrame) -> DataFrame:
    """lines with d (a line's brace balance) and cum (the file's balance after it)."""
    upto = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("d", brace_balance(F.col("text"))).withColumn("cum", F.sum("d").over(upto))


def remove_container(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Files (path, content) with the container at heads (path, head) taken out.

    The head line is blanked, its closing brace dropped, the body moved left by two.
    """
    rows = with_balance(lines).join(heads, "path")
    before = F.max(F.when(F.col("line_no") == F.col("head"), F.col("cum") - F.col("d"))).over(W.partitionBy("path"))
    rows = rows.withColumn("before", before)
    close = F.min(F.when((F.col("line_no") >= F.col("head")) & (F.col("cum") <= F.col("before")), F.col("line_no"))).over(W.partitionBy("path"))
    rows = rows.withColumn("close", F.coalesce(close, F.col("head")))
    n, head, end = (F.col(x) for x in ("line_no", "head", "close"))
    text = (
        F.when(n == head, F.lit(""))
        .when(n == end, F.regexp_replace("text", r"^([^}]*)\}", "$1"))
        .when((n > head) & (n < end) & F.col("text").startswith("  "), F.substring("text", 3, 1 << 30))
        .otherwise(F.col("text"))
    )
    return rows.groupBy("path").agg(ordered_text("line_no", text).alias("content"))


def flex_to_row_column(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Files with the container head at heads (path, head) written as Column or Row.

    Its arguments run to the line where round brackets balance again; they say which.
    """
    span = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.join(heads, "path")
    d = F.regexp_count("text", F.lit(r"\(")) - F.regexp_count("text", F.lit(r"\)"))
    after = F.col("line_no") >= F.col("head")
    rows = rows.withColumn("cum", F.sum(F.when(after, d).otherwise(0)).over(span))
    whole = W.partitionBy("path")
    close = F.min(F.when(after & (F.col("cum") <= 0), F.col("line_no"))).over(whole)
    rows = rows.withColumn("close", F.coalesce(close, F.col("head")))
    inside = after & (F.col("line_no") <= F.col("close"))
    column = F.coalesce(F.max(inside & F.col("text").contains("FlexDirection.Column")).over(whole), F.lit(False))
    opened = F.coalesce(F.max(inside & F.rtrim("text").endswith("{")).over(whole), F.lit(False))
    indent = F.regexp_extract("text", r"^(\s*)", 1)
    written = F.concat(indent, F.when(column, "Column()").otherwise("Row()"), F.when(opened, " {").otherwise(""))
    rows = rows.withColumn("text", F.when(F.col("line_no") == F.col("head"), written).otherwise(F.col("text")))
    rows = rows.where(~inside | (F.col("line_no") == F.col("head")))
    return rows.groupBy("path").agg(ordered_text("line_no", "text").alias("content"))
