"""Readers and writers of files, reports, examples, rules, vectors, graphs and program facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.columns import ordered_text
from codequarry.operators.joins import last_write_wins

REPORT = "`Source File` string, `Line` string, `RuleName` string, `Detail` string"
EXEMPLAR = "id string, rule string, description string, problem_code string, problem_explain string, problem_fix string, gpt_diff string, difflib string"


def scan_sources(spark: SparkSession, root: str, exts: list[str], ignore: list[str] = ()) -> DataFrame:
    """path, ext, content of files below root; ignored names are skipped, bad bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    rows = files.select("path", ext.alias("ext"), F.decode("content", "UTF-8").alias("content")).where(F.col("ext").isin(*exts))
    for name in ignore:
        rows = rows.where(~F.contains("path", F.lit(f"/{name}/")) & ~F.endswith("path", F.lit(f"/{name}")))
    return rows


def read_findings(spark: SparkSession, path: str, rnd: int | None = None) -> DataFrame:
    """Reports whose first line is a title and whose second is the header; fixed schema."""
    rows = spark.read.schema(REPORT).csv(path, header=False, escape='"', multiLine=True)
    rows = rows.where(F.col("Line").isNotNull() & (F.col("Line") != "Line"))
    named = rows.withColumnsRenamed({"Source File": "path", "RuleName": "rule", "Detail": "detail"}).withColumn("line", F.col("Line").cast("int"))
    return named.select(*([F.lit(rnd).alias("round")] if rnd is not None else []), "path", "line", "rule", "detail")


def write_report(findings: DataFrame, path: str, title: str) -> None:
    """findings as reports with a title line and a header line in each file."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    body = findings.select(F.concat_ws(",", *[cell(c) for c in ("path", "line", "rule", "detail")]).alias("value"))

    def framed(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [title, "Source File,Line,RuleName,Detail"]})
        yield from batches

    body.mapInPandas(framed, "value string").write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    """Solved examples from CSV with texts of many lines; blank diffs are null."""
    rows = spark.read.schema(EXEMPLAR).csv(path, header=True, multiLine=True, escape='"')
    blank = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    return rows.select(*[blank(c) if c in ("gpt_diff", "difflib") else c for c in rows.columns])


def read_rule_meta(spark: SparkSession, path: str, bad_pages: DataFrame) -> DataFrame:
    """Rule records from a JSON array, with the bad page (stem, content) of the rule's stem."""
    schema = "rule string, errorLocation string, fixLocation string, needsMoreContext boolean"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    rows = rows.select("rule", F.col("errorLocation").alias("error_location"), F.col("fixLocation").alias("fix_location"), F.col("needsMoreContext").alias("needs_context"))
    return rows.withColumn("stem", F.substring_index("rule", "/", -1)).join(bad_pages.select("stem", F.col("content").alias("bad_code")), "stem", "left").drop("stem")


STATEMENT = "struct<kind:string,def:string,uses:array<string>,callee:string,args:array<string>>"
FACTS = f"file string, classes array<struct<name:string,superclass:string,type:string,methods:array<struct<name:string,modifiers:int,blocks:array<struct<id:int,successors:array<int>,stmts:array<{STATEMENT}>>>>>>>"


def read_program_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Fact tables classes, methods, blocks, cfg_edges and stmts from nested JSON files."""
    rows = spark.read.schema(FACTS).json(path)
    classes = rows.select("file", F.explode_outer("classes").alias("c")).where("c is not null")
    methods = classes.select("file", F.col("c.name").alias("class"), F.explode_outer("c.methods").alias("m")).where("m is not null")
    key = F.concat_ws(".", "file", "class", F.col("m.name"))
    blocks = methods.select(key.alias("method"), F.posexplode_outer("m.blocks").alias("pos", "b")).where("b is not null")
    return {
        "classes": classes.select("file", F.col("c.name").alias("class"), F.col("c.superclass").alias("superclass"), F.try_parse_json("c.type").alias("type")),
        "methods": methods.select("file", "class", F.col("m.name").alias("name"), F.col("m.modifiers").alias("modifiers"), key.alias("method")),
        "blocks": blocks.select("method", F.col("b.id").alias("block_id"), (F.col("pos") == 0).alias("is_start")),
        "cfg_edges": blocks.select("method", F.col("b.id").alias("src"), F.explode("b.successors").alias("dst")),
        "stmts": blocks.select("method", F.col("b.id").alias("block_id"), F.posexplode("b.stmts").alias("idx", "s")).select("method", "block_id", "idx", "s.*"),
    }


def write_round(files: DataFrame, path: str) -> None:
    """files (round, project, path, content) under round and project; a rerun replaces only
    the partitions that it writes."""
    files.write.partitionBy("round", "project").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_pairs(exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problem and repair texts by key rule_index."""
    key = F.concat_ws("_", "rule", F.col("index").cast("string")).alias("key")
    return exemplars.select(key, F.col("problem_code").alias("text")), exemplars.select(key, F.col("problem_fix").alias("text"))


def import_pairs(exemplars: DataFrame, problems: DataFrame, repairs: DataFrame) -> DataFrame:
    """exemplars with the texts of edited pair tables; rows without both files are dropped."""
    rows = exemplars.withColumn("key", F.concat_ws("_", "rule", F.col("index").cast("string")))
    rows = rows.join(problems.select("key", F.col("text").alias("_p")), "key").join(repairs.select("key", F.col("text").alias("_r")), "key")
    return rows.withColumns({"problem_code": F.coalesce("_p", "problem_code"), "problem_fix": F.coalesce("_r", "problem_fix")}).drop("_p", "_r")


def vector_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vector rows (id, seq, embedding, metadata): the last write of each id, no null metadata.

    Rows without a vector are left out and don't stop the others.
    """
    rows = stored.unionByName(fresh).where("embedding is not null and size(embedding) > 0")
    return last_write_wins(rows, "id", "seq").withColumn("metadata", F.map_filter("metadata", lambda _, v: v.isNotNull()))


def export_dot(nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """graph, text: one text graph for each graph id, nodes then edges in order.

    start (graph, id): only what these nodes reach, in their graph; others have no row.
    """
    if start is not None:
        from codequarry.operators.graph import reachable

        seen = reachable(edges, start.select("graph", F.col("id").alias("root"), F.col("id").alias("node")), ("graph",)).select("graph", F.col("node").alias("id")).distinct()
        nodes, edges = nodes.join(seen, ["graph", "id"], "left_semi"), edges.join(seen.withColumnRenamed("id", "src"), ["graph", "src"], "left_semi")
    n = nodes.select("graph", F.struct(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("o"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), F.col("name"), F.lit('"];')).alias("t"))
    e = edges.select("graph", F.struct(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("o"), F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("t"))
    body = n.union(e).groupBy("graph").agg(ordered_text("o", "t").alias("b"))
    return body.select("graph", F.concat(F.lit('digraph "'), F.col("graph").cast("string"), F.lit('" {\n'), "b", F.lit("\n}")).alias("text"))


def nest_program(blocks: DataFrame, cfg_edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """method, json: blocks with sorted successors and predecessors, and their statements."""
    succ = cfg_edges.groupBy("method", F.col("src").alias("block")).agg(F.array_sort(F.collect_list("dst")).alias("successors"))
    pred = cfg_edges.groupBy("method", F.col("dst").alias("block")).agg(F.array_sort(F.collect_list("src")).alias("predecessors"))
    body = stmts.groupBy("method", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "def", "use"))), lambda s: F.struct(s["def"].alias("def"), s["use"].alias("use"))).alias("stmts"))
    rows = blocks.join(succ, ["method", "block"], "left").join(pred, ["method", "block"], "left").join(body, ["method", "block"], "left")
    none = F.array().cast("array<int>")
    item = F.struct(F.col("block").alias("id"), F.coalesce("successors", none).alias("successors"), F.coalesce("predecessors", none).alias("predecessors"), "stmts")
    return rows.groupBy("method").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))
