"""A whole repair round, from findings to the files of the next round: R1.

Findings get their context as line ranges, those whose ranges meet are one group, each group
is asked about once, with solved examples of its rules, and the answers are put back into the
file at the group's ranges. The new files are tidied and checked; a file that fails is asked
about again, and after the last attempt it keeps its text. All files go through each step
together: a round is a few plans, not a loop over files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.columns import ordered_text
from codequarry.operators import text as X
from codequarry.operators.context import GAP, enclosing_block, group_multi_range, related_lines
from codequarry.operators.declarations import hoist_declarations
from codequarry.operators.joins import with_rule_meta
from codequarry.operators.repair import answer
from codequarry.operators.retrieve import embed, top_k_examples
from codequarry.plans.fixpoint import stored
from codequarry.streaming.incremental import resume

ATTEMPTS, EXAMPLES = 3, 1
Responder = Callable[[], Callable[[str], str]]
Encoder = Callable[[], Callable[[list[str]], list[list[float]]]]


def context_ranges(findings: DataFrame, lines: DataFrame, meta: DataFrame) -> DataFrame:
    """path, id (line and rule), start, end: the block of each finding, and its related lines if the rule needs them."""
    rows = stored(enclosing_block(with_rule_meta(findings.select("path", F.col("line").cast("int").alias("line"), "rule").distinct(), meta), lines))
    rows = stored(rows.withColumn("id", F.struct("path", "line", "rule")))
    more = rows.where("needs_context").select("path", "line", "id").join(stored(related_lines(rows.where("needs_context"), lines)), ["path", "line"])
    number = lambda c: F.col(c).cast("int")
    return stored(rows.select("path", "id", number("start").alias("start"), number("end").alias("end")).union(stored(more).select("path", "id", number("line_no").alias("start"), (F.col("line_no").cast("int") + 0).alias("end"))).distinct())


def grouped(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """path, group_id, parts (start, end, text of each merged range, in order), findings (line, rule)."""
    groups = stored(group_multi_range(ranges))
    spans = ranges.join(groups, "id").select("path", "group_id", "start", "end").distinct()
    w = W.partitionBy("path", "group_id").orderBy("start", "end")
    past = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_new", (past.isNull() | (F.col("start") > past + 1)).cast("int"))
    spans = spans.withColumn("_k", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("path", "group_id", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    held = merged.withColumn("line_no", F.explode(F.sequence("start", "end"))).join(lines, ["path", "line_no"])
    parts = held.groupBy("path", "group_id", "start", "end").agg(ordered_text("line_no", "text").alias("text"))
    parts = parts.groupBy("path", "group_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("parts"))
    named = groups.select("group_id", F.col("id.line").alias("line"), F.col("id.rule").alias("rule")).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("line", "rule"))).alias("findings"))
    return parts.join(named, "group_id")


def prompts(groups: DataFrame, examples: DataFrame, vectors: DataFrame, make_encoder: Encoder, k: int = EXAMPLES) -> DataFrame:
    """groups with code and prompt; findings of rules without an example, and groups of such alone, are left out.

    examples: id, rule, problem, note, fix; vectors: id, rule, vec.
    """
    code = stored(groups.withColumn("code", F.array_join(F.transform("parts", lambda p: p["text"]), GAP)))
    asked = code.select("group_id", "code", F.explode(F.array_distinct(F.transform("findings", lambda f: f["rule"]))).alias("rule"))
    vectored = stored(embed(code.select("group_id", "code"), "code", make_encoder)).select("group_id", F.col("embedding").alias("qvec"))
    queries = asked.join(vectored, "group_id").select(F.struct("group_id", "rule").alias("qid"), "rule", "qvec")
    best = top_k_examples(queries, vectors, k).join(examples, "id")
    shown = F.concat(F.lit("Example:\n"), "problem", F.lit("\nBecause: "), "note", F.lit("\nFixed:\n"), "fix")
    texts = best.groupBy(F.col("qid.group_id").alias("group_id")).agg(ordered_text(F.struct("qid.rule", "place"), shown, "\n\n").alias("shown"), F.collect_set("qid.rule").alias("known"))
    rows = code.join(texts, "group_id")
    kept = F.filter("findings", lambda f: F.array_contains("known", f["rule"]))
    listed = F.array_join(F.transform(kept, lambda f: F.concat(F.lit("line "), f["line"].cast("string"), F.lit(": "), f["rule"])), "\n")
    return rows.withColumn("prompt", F.concat("shown", F.lit("\n\nFindings:\n"), listed, F.lit("\nCode:\n"), "code")).drop("shown", "known")


def splice(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """path, line_no, text: the files with the lines of each range replaced by a new text.

    patches: path, start, end, text; ranges of one file don't overlap. Files without a patch
    are left out.
    """
    fresh = patches.select("path", F.col("start").alias("at"), F.posexplode(F.split("text", "\n")).alias("sub", "text"))
    covered = patches.select("path", F.explode(F.sequence("start", "end")).alias("line_no"))
    kept = lines.join(patches.select("path").distinct(), "path", "left_semi").join(covered, ["path", "line_no"], "left_anti")
    rows = kept.select("path", F.col("line_no").cast("int").alias("at"), F.lit(0).alias("sub"), "text").union(fresh.select("path", F.col("at").cast("int"), "sub", "text"))
    return rows.select("path", F.row_number().over(W.partitionBy("path").orderBy("at", "sub")).alias("line_no"), "text")


def balanced(original: DataFrame, fixed: DataFrame) -> DataFrame:
    """path, success: the usual check, that no bracket of the new text is extra, mismatched or open."""
    bad = X.bracket_report(X.explode_lines(fixed)).select("path").distinct().withColumn("_bad", F.lit(True))
    return fixed.select("path").join(bad, "path", "left").select("path", F.col("_bad").isNull().alias("success"))


def run_files(files: DataFrame, findings: DataFrame, meta: DataFrame, examples: DataFrame, vectors: DataFrame, make_responder: Responder, make_encoder: Encoder, attempts: int = ATTEMPTS, k: int = EXAMPLES, check: Callable[[DataFrame, DataFrame], DataFrame] = balanced) -> DataFrame:
    """path, content, status, attempt for each file: unchanged (nothing to ask), fixed or failed.

    A responder gets the prompt, with the number of the attempt from the second on, and
    answers with the code, its parts between the same marks as in the prompt. An answer with
    another number of parts, or none, fails its file for this attempt. check(original, fixed)
    gives path and success.
    """
    files = stored(files.select("path", "content"))
    lines = stored(X.explode_lines(files).select("path", "line_no", "text"))
    asked = stored(prompts(grouped(context_ranges(findings.join(files.select("path"), "path", "left_semi"), lines, meta), lines), examples, vectors, make_encoder, k))
    left, done = asked.select("path").distinct(), None
    for n in range(1, attempts + 1):
        if left.isEmpty():
            break
        now = asked.join(left, "path", "left_semi")
        now = now if n == 1 else now.withColumn("prompt", F.concat(F.lit(f"Attempt {n}\n"), "prompt"))
        replies = stored(answer(now, make_responder))
        # the newline before the closing fence isn't the code's
        code = F.regexp_replace(X.apply_diff_markers(X.code_block(F.coalesce("reply", F.lit("")))), r"\n\z", "")
        replies = replies.withColumn("_new", F.split(code, _quoted(GAP), -1)).withColumn("_fits", F.col("reply").isNotNull() & (F.size("_new") == F.size("parts")))
        whole = replies.groupBy("path").agg(F.min("_fits").alias("_whole")).where("_whole").select("path")
        patches = replies.join(whole, "path", "left_semi").select("path", F.explode(F.arrays_zip("parts", "_new")).alias("p")).select("path", "p.parts.start", "p.parts.end", F.col("p._new").alias("text"))
        fixed = stored(hoist_declarations(splice(lines, patches)))
        passed = check(files, fixed).where("success").select("path")
        good = stored(fixed.join(passed, "path", "left_semi").withColumn("attempt", F.lit(n)))
        done = good if done is None else done.union(good)
        left = stored(left.join(good.select("path"), "path", "left_anti"))
    result = files.withColumnRenamed("content", "_old").join(asked.select("path").distinct().withColumn("_asked", F.lit(True)), "path", "left")
    if done is None:
        return result.select("path", F.col("_old").alias("content"), F.when(F.col("_asked"), "failed").otherwise("unchanged").alias("status"), F.lit(None).cast("int").alias("attempt"))
    result = result.join(done, "path", "left")
    status = F.when(F.col("attempt").isNotNull(), "fixed").when(F.col("_asked"), "failed").otherwise("unchanged")
    return result.select("path", F.coalesce("content", "_old").alias("content"), status.alias("status"), "attempt")


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if c in "\\.^$|?*+()[]{}/" else c for c in mark)


def repair_round(spark: SparkSession, out: str, rnd: int, files: DataFrame, *tables: DataFrame, **more) -> DataFrame:
    """run_files on the files that the round's table doesn't hold yet, added to that table; all of it.

    The table is its own marker: an unfinished job leaves no rows, so a rerun does those
    files again and skips the rest. Its contents are the files of the next round.
    """
    path, schema = f"{out.rstrip('/')}/round={rnd}", "path string, content string, status string, attempt int"
    try:
        before = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no such table yet
        before = None
    todo = files if before is None else resume(files, before.select("path"))
    run_files(todo, *tables, **more).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
