"""Context of findings: blocks, related lines, groups, snippets and assembled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.columns import ordered_text
from codequarry.operators.joins import held_in, with_rule_meta
from codequarry.operators.text import identifiers_at
from codequarry.operators.windows import block_end, merge_ranges, next_place

#: Names that begin a block of interest.
HEAD = r"(for|if|while|ForEach|LazyForEach|List|ListItem|Grid|Flex|Column|Row|Stack|Scroll|Swiper|TabContent|Panel|Navigation|RelativeContainer|WaterFlow|\.on\w+|aboutToReuse)\s*.*\{"
GAP = "\n// ...\n"


def enclosing_block(findings: DataFrame, lines: DataFrame, head: Column | None = None) -> DataFrame:
    """findings with start, end: the outermost block that holds the line, else the line."""
    blocks = block_end(lines, F.col("text").rlike(HEAD) if head is None else head)
    outer = held_in(findings, blocks).select("path", "line", F.struct("head", "end").alias("_b"))
    rows = findings.join(outer, ["path", "line"], "left")
    return rows.withColumns({"start": F.coalesce("_b.head", "line"), "end": F.coalesce("_b.end", "line")}).drop("_b")


def related_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """path, line, line_no, role: lines that define or use the names at a finding, outside its block.

    findings: path, line, start, end (of the enclosing block).
    """
    at = lines.select("path", F.col("line_no").alias("line"), F.explode(identifiers_at(F.col("text"))).alias("name"))
    wanted = findings.select("path", "line", "start", "end").distinct().join(at, ["path", "line"])
    hints = lines.where(F.col("text").rlike(r"@\w|let|this\."))
    rows = wanted.join(hints, "path").where(F.contains("text", "name") & ~F.col("line_no").between(F.col("start"), F.col("end")))
    defines = F.rlike("text", F.concat(F.lit(r"(@\w+.*"), "name", F.lit("|let.*"), "name", F.lit(r".*=).*;")))
    uses = F.contains("text", F.concat(F.lit("this."), "name"))
    rows = rows.withColumn("role", F.when(defines, "definition").when(uses, "usage")).where("role is not null")
    return rows.select("path", "line", "line_no", "role").distinct()


def outermost_only(blocks: DataFrame) -> DataFrame:
    """Blocks (path, head, end) that don't begin inside a block before them."""
    past = F.max("end").over(W.partitionBy("path").orderBy("head", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("_past", past).where("_past is null or head > _past").drop("_past")


def indent_blocks(lines: DataFrame, is_head: Column) -> DataFrame:
    """path, head, end: the lines after a head that are blank or deeper than it."""
    indent = F.length("text") - F.length(F.ltrim("text"))
    rows = lines.withColumn("indent", indent)
    heads = rows.where(is_head).select("path", F.col("line_no").alias("head"), F.col("indent").alias("own"))
    stops = rows.where(F.trim("text") != "").select("path", "line_no", "indent")
    # for each depth that a file has, at most the head's own, the next line of that depth
    asked = heads.join(stops.select("path", "indent").distinct(), "path").where("indent <= own").select("path", "indent", "head")
    found = next_place(asked, stops, ["path", "indent"]).groupBy("path", "head").agg(F.min("next").alias("stop"))
    cut = heads.select("path", "head").join(found, ["path", "head"], "left")
    last = lines.groupBy("path").agg(F.max("line_no").alias("_last"))
    return cut.join(last, "path").select("path", "head", F.coalesce(F.col("stop") - 1, "_last").alias("end"))


def finding_context(findings: DataFrame, lines: DataFrame, meta: DataFrame) -> DataFrame:
    """path, line, rule, context: the block, and related lines where the rule needs them."""
    rows = enclosing_block(with_rule_meta(findings, meta), lines)
    keys = ["path", "line", "rule"]
    own = rows.select(*keys, F.explode(F.sequence("start", "end")).alias("line_no"))
    more = rows.where("needs_context").select(*keys).join(related_lines(rows.where("needs_context"), lines), ["path", "line"]).select(*keys, "line_no")
    chosen = own.unionByName(more).distinct()
    return chosen.join(lines, ["path", "line_no"]).groupBy(*keys).agg(ordered_text("line_no", "text").alias("context"))


def group_findings(ranges: DataFrame) -> DataFrame:
    """path, id, group_id: findings of one range each, grouped where ranges overlap or touch."""
    w = W.partitionBy("path").orderBy("start", "end", "id")
    past = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (past.isNull() | (F.col("start") > past + 1)).cast("int"))
    rows = rows.withColumn("_k", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("group_id", F.min("id").over(W.partitionBy("path", "_k"))).select("path", "id", "group_id")


def group_multi_range(ranges: DataFrame) -> DataFrame:
    """id, group_id: findings of many ranges, grouped by chains of overlaps.

    Ranges of a file that meet in a row are one island. Each finding is tied to the first
    one of each of its islands, so links are as many as ranges, not as pairs of them.
    """
    from codequarry.operators.graph import connected_components

    w = W.partitionBy("path").orderBy("start", "end")
    past = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (past.isNull() | (F.col("start") > past + 1)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min("id").over(W.partitionBy("path", "_island"))
    links = rows.select(F.col("id").alias("src"), first.alias("dst")).where("src <> dst").distinct()
    found = connected_components(links).withColumnsRenamed({"id": "_id"})
    ids = ranges.select("id").distinct()
    return ids.join(found, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("group_id"))


def group_snippets(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """path, start, end, snippet: the text of each merged range, trimmed at its end."""
    merged = merge_ranges(ranges).select("path", "start", "end")
    at = merged.withColumn("line_no", F.explode(F.sequence("start", "end")))
    rows = at.join(lines.withColumn("line_no", F.col("line_no").cast("long")), ["path", "line_no"])
    return rows.groupBy("path", "start", "end").agg(F.rtrim(ordered_text("line_no", "text")).alias("snippet"))


def masked_context(snippets: DataFrame) -> DataFrame:
    """path, context: a file's snippets in order, with a mark where lines are left out."""
    return snippets.groupBy("path").agg(ordered_text("start", "snippet", GAP).alias("context"))


def assemble_prompt(groups: DataFrame, examples: DataFrame, mode: str = "explained") -> DataFrame:
    """group_id, prompt. groups: group_id, rule, findings, code; examples: rule, place, problem, fix, note.

    mode: none, explained (with the note) or diff (marked lines).
    """
    head = F.concat(F.lit("Findings:\n"), "findings", F.lit("\nCode:\n"), "code")
    if mode == "none":
        return groups.select("group_id", head.alias("prompt"))
    fixed = F.concat(F.lit("-"), "problem", F.lit("\n+"), "fix") if mode == "diff" else F.concat("problem", F.lit("\nBecause: "), "note", F.lit("\nFixed:\n"), "fix")
    shown = F.concat(F.lit("Example "), F.col("place").cast("string"), F.lit(":\n"), fixed)
    texts = examples.groupBy("rule").agg(ordered_text("place", shown, "\n\n").alias("shown"))
    rows = groups.join(texts, "rule", "left")
    return rows.select("group_id", F.concat_ws("\n\n", "shown", head).alias("prompt"))


def assemble_rule_catalogue(rules: DataFrame) -> DataFrame:
    """One row, catalogue: all rules in order of their key. Rules are few, as pages of a manual."""
    line = F.concat("rule", F.lit(": "), "description", F.lit("\nBad: "), "bad_example", F.coalesce(F.concat(F.lit("\nGood: "), "good_example"), F.lit("")))
    return rules.agg(ordered_text("rule", line, "\n\n").alias("catalogue"))


def assemble_patch_request(results: DataFrame) -> DataFrame:
    """path, request: all segments of a file with their diffs, in order."""
    part = F.concat(F.lit("Segment "), F.col("seg").cast("string"), F.lit(":\n"), "segment", F.lit("\nDiff:\n"), "diff")
    return results.groupBy("path").agg(ordered_text("seg", part, "\n").alias("request"))


