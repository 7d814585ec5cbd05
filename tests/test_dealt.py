"""Rows in buckets: what is stored isn't shuffled again, and rounds find the same rows."""

import contextlib
import io

from pyspark.sql import functions as F

from codequarry.plans.fixpoint import dealt, fixpoint


def shuffles(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().count("Exchange hashpartitioning")


def test_a_join_shuffles_only_the_other_side(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("a"), F.struct(F.col("id").alias("v"), F.lit(None).cast("long").alias("f")).alias("b"))
    t = dealt(rows, ["a"])
    asked = spark.createDataFrame([(3, "x"), (3, "y"), (11, "z"), (None, "n")], "a int, tag string")
    both = t.join(asked)
    assert shuffles(both) == 1
    assert both.count() == 20 and set(both.columns) == {"a", "tag", "b"}
    by_struct = dealt(rows, ["b"])
    assert by_struct.join(rows.where("a = 4").select(F.col("b").alias("c")), ["c"]).count() == 10
    assert shuffles(by_struct.fresh(rows)) == 1 and by_struct.fresh(rows).count() == 0


def test_rounds_past_a_merge_keep_all_rows(spark):
    n = 45  # more than MERGED
    found = fixpoint(spark.range(1).select("id", F.array("id").alias("at")), lambda d, _: d.where(F.col("id") < n).select(F.col("id") + 1, F.array(F.col("id") + 1)).toDF("id", "at"), ["id", "at"])
    assert sorted(r.id for r in found.collect()) == list(range(n + 1))


def test_few_rows_are_shuffled_and_the_stored_ones_not_sorted(spark):
    t = dealt(spark.range(100).select((F.col("id") % 10).alias("a"), F.col("id").alias("b")), ["a"])
    both = t.join(spark.createDataFrame([(3, "x"), (11, "z"), (None, "n")], "a int, tag string"), few=True)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert shuffles(both) == 1 and "ShuffledHashJoin" in plan and "Sort " not in plan
    assert both.count() == 10
