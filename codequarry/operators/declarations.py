"""Declarations in component code: where they stand, and moving them to where they belong.

Scopes are intervals between a head line and its closing brace, found by balances in
windows; a line belongs to the innermost scope that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.columns import ordered_text
from codequarry.operators.joins import held_in
from codequarry.operators.windows import block_end

#: Heads of scopes by kind, the first that fits, and the known decorators.
HEADS = (
    ("component", r"^\s*(export\s+)?struct\s+\w+.*\{\s*$"),
    ("build", r"^\s*build\s*\(\s*\)\s*\{\s*$"),
    ("arrow", r"=>\s*\{\s*$"),
    ("function", r"^\s*(async\s+|private\s+)?\w+\s*\([^)]*\)\s*(:\s*\w+\s*)?\{\s*$"),
    ("block", r"\{\s*$"),
)
DECLARES = r"^\s*(let|const)\s+\w+"
DECORATORS = "State Prop Link Provide Consume ObjectLink Observed Watch StorageLink StorageProp LocalStorageLink LocalStorageProp Builder BuilderParam Styles Extend Entry Component Reusable Preview CustomDialog".split()


def _kind(text):
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def scopes(lines: DataFrame) -> DataFrame:
    """path, head, end, kind of each scope. A container call like Column() is a block."""
    kind = _kind(F.col("text"))
    kind = F.when((kind == "function") & F.col("text").rlike(r"^\s*(if|for|while|switch|[A-Z]\w*)\s*\("), "block").otherwise(kind)
    heads = lines.withColumn("kind", kind).where("kind is not null").select("path", F.col("line_no").alias("head"), "kind")
    return block_end(lines, F.col("text").rlike(HEADS[-1][1])).join(heads, ["path", "head"])


def innermost(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines (path, line_no, text) with scope and head: the innermost scope around each, or null."""
    held = held_in(lines.select("path", F.col("line_no").alias("line")), found, inner=True)
    held = held.join(found.select("path", "head", "kind"), ["path", "head"]).select("path", F.col("line").alias("line_no"), F.col("kind").alias("scope"), "head")
    return lines.join(held, ["path", "line_no"], "left").select("path", "line_no", "text", "scope", "head")


def declaration_report(lines: DataFrame) -> DataFrame:
    """path, line_no, problem, suggestion.

    let and const directly in a component's body lose the word; in build, or in blocks of
    it that are no callbacks, they belong to the component; decorators must be known.
    """
    found = scopes(lines)
    candidates = lines.where(F.col("text").rlike(DECLARES) | F.col("text").rlike(r"^\s*@\w+"))
    rows = innermost(candidates, found.where("kind <> 'block'"))
    declares = F.col("text").rlike(DECLARES)
    name = F.regexp_extract("text", r"^\s*@(\w+)", 1)
    problem = F.when(declares & (F.col("scope") == "component"), "declared in component").when(declares & (F.col("scope") == "build"), "declared in build").when((name != "") & ~name.isin(DECORATORS), "unknown decorator")
    bare = F.regexp_replace("text", r"^(\s*)(?:let|const)\s+", "$1")
    suggestion = F.when(problem == "unknown decorator", F.regexp_replace("text", r"^(\s*)@\w+\s*", "$1")).otherwise(bare)
    return rows.withColumns({"problem": problem, "suggestion": suggestion}).where("problem is not null").select("path", "line_no", "problem", "suggestion")


def hoist_declarations(lines: DataFrame) -> DataFrame:
    """path, content: declarations of build moved below their component's head.

    Later lines of the file read a moved name as this.name; runs of blank lines shrink to
    one. A declaration in build without a component around it stays where it is.
    """
    found = scopes(lines)
    report = declaration_report(lines).where("problem = 'declared in build'")
    parts = held_in(report.select("path", F.col("line_no").alias("line")), found.where("kind = 'component'"), inner=True)
    moved = report.join(parts.select("path", F.col("line").alias("line_no"), F.col("head").alias("c")), ["path", "line_no"]).select("path", "line_no", "suggestion", "c")
    moved = moved.withColumn("name", F.regexp_extract("suggestion", r"^\s*(\w+)", 1))
    names = moved.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "name"))).alias("moved"))
    rows = lines.join(names, "path", "left").join(moved.select("path", "line_no", "c", "suggestion"), ["path", "line_no"], "left")
    # fold over the names moved from lines before this one; one already read as this.x stays
    rewritten = F.aggregate(
        F.filter(F.coalesce("moved", F.array().cast("array<struct<line_no:int,name:string>>")), lambda m: m["line_no"] < F.col("line_no")),
        F.col("text"),
        lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w.])"), m["name"], F.lit(r"\b(?!\s*:)")), F.concat(F.lit("this."), m["name"])),
    )
    rows = rows.withColumn("text", F.when(F.col("c").isNotNull(), F.col("suggestion")).otherwise(rewritten))
    rows = rows.withColumn("place", F.when(F.col("c").isNotNull(), F.struct(F.col("c").alias("a"), F.col("line_no").alias("b"))).otherwise(F.struct(F.col("line_no").alias("a"), F.lit(0).alias("b"))))
    blank = F.trim("text") == ""
    before = F.lag(blank).over(W.partitionBy("path").orderBy("place"))
    rows = rows.withColumn("_squeeze", blank & F.coalesce(before, F.lit(False))).where("not _squeeze")
    return rows.groupBy("path").agg(ordered_text("place", "text").alias("content"))
