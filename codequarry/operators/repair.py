"""The repair loop: batch answers, retries, verdicts and the next round."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.operators import text as X
from codequarry.operators.context import finding_context


def answer(prompts: DataFrame, make_responder: Callable[[], Callable[[str], str]], retries: int = 3, wait: float = 0.0, prompt_col: str = "prompt") -> DataFrame:
    """prompts with reply and error. A failed call is tried again, each time waiting twice
    as long; after ``retries`` tries the reply is null and error says why. Other columns stay in Arrow."""

    def call(batches: Iterator) -> Iterator:
        import pyarrow as pa

        responder = make_responder()
        for b in batches:
            replies, errors = [], []
            for p in b.column(b.schema.get_field_index(prompt_col)).to_pylist():
                reply = error = None
                for k in range(retries):
                    try:
                        reply, error = responder(p), None
                        break
                    except Exception as e:  # noqa: BLE001  the row keeps it
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k)
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "reply", "error"])

    return prompts.mapInArrow(call, T.StructType([*prompts.schema, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))


def retry_until(attempts: DataFrame, originals: DataFrame, most: int = 3) -> DataFrame:
    """key, text, fixed: the first successful of ``most`` attempts, else the original text."""
    won = attempts.where((F.col("attempt") <= most) & F.col("success")).groupBy("key").agg(F.min_by("text", "attempt").alias("_fixed"))
    rows = originals.join(won, "key", "left")
    return rows.select("key", F.coalesce("_fixed", "text").alias("text"), F.col("_fixed").isNotNull().alias("fixed"))


def gate(originals: DataFrame, fixed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """key, text: the fixed text where the verdict is success, else the original."""
    rows = originals.join(fixed.withColumnRenamed("text", "_fixed"), "key", "left").join(verdicts, "key", "left")
    return rows.select("key", F.when(F.col("success"), F.coalesce("_fixed", "text")).otherwise(F.col("text")).alias("text"))


def next_round(files: DataFrame, fixed: DataFrame, rnd: int) -> DataFrame:
    """Files of round ``rnd`` with fixes in place, as files of the next round."""
    rows = files.where(F.col("round") == rnd).join(fixed.select("path", F.col("content").alias("_new")), "path", "left")
    return rows.select(F.lit(rnd + 1).alias("round"), "path", F.coalesce("_new", "content").alias("content"))


def run_round(findings: DataFrame, lines: DataFrame, meta: DataFrame, make_responder: Callable[[], Callable[[str], str]]) -> DataFrame:
    """path, line, rule, code, success: one round from findings to cleaned answers."""
    context = finding_context(findings, lines, meta)
    asked = context.withColumn("prompt", F.concat(F.lit("Rule "), "rule", F.lit("\n"), "context"))
    replies = answer(asked, make_responder)
    code = X.apply_diff_markers(X.code_block(F.coalesce("reply", F.lit(""))))
    rows = replies.withColumn("code", F.when(F.col("reply").isNotNull(), code).otherwise(F.col("context")))
    opens, closes = (F.regexp_count("code", F.lit(x)) for x in (r"\{", r"\}"))
    return rows.select("path", "line", "rule", "code", (F.col("reply").isNotNull() & (opens == closes)).alias("success"))
