"""Domain tables derived from the driver's tables; each function takes (spark, sf_dir).

SQL holds the same definitions for DuckDB, as common table expressions by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.plans.fixpoint import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> int:
    """Number of customers: the graphs' nodes are 0 to this, less 1."""
    return table(spark, sf_dir, "customer").count()


def x_findings(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rnd = F.floor((F.dayofmonth("ts") - 1) / 5).cast("int")
    folder = F.when(rnd == 0, F.lit("origin")).otherwise(F.concat(F.lit("round_"), rnd.cast("string"), F.when(F.col("event_id") % 10 == 0, F.lit("_reject")).otherwise(F.lit(""))))
    user = F.col("user_id").cast("string")
    path = F.concat(F.lit("C:\\x\\"), folder, F.lit("\\proj"), (F.col("user_id") % 7).cast("string"), F.lit("\\ets\\f"), user, F.lit(".ets"))
    return e.select("event_id", F.least(rnd, F.lit(5)).alias("round"), F.col("user_id").alias("file"), F.col("event_type").alias("rule"), (F.col("event_id") % 40 + 1).cast("int").alias("line"), F.col("props").alias("detail"), path.alias("path"))


def x_ranges(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = (F.col("event_id") % 2000 + 1).cast("long")
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("id"), start.alias("start"), (start + F.col("event_id") % 5).alias("end"))


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def code_text(flag: Column, status: Column, var: Column) -> Column:
    """One line of code for a (flag, status) pair."""
    v = var.cast("string")
    return (
        F.when((flag == "N") & (status == "O"), F.lit("  Column() {"))
        .when((flag == "R") & (status == "F"), F.lit("  for (let i = 0; i < 3; i++) {"))
        .when((flag == "A") & (status == "O"), F.concat(F.lit("  @State v"), v, F.lit(": number = 0;")))
        .when((flag == "R") & (status == "O"), F.concat(F.lit("  this.v"), v, F.lit(" += 1;")))
        .otherwise(F.lit("  }"))
    )


def x_code_rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("path", F.floor(F.col("l_orderkey") / 16).cast("long"))
    li = li.withColumn("line_no", F.row_number().over(W.partitionBy("path").orderBy(*LINE_ORDER)))
    return li.withColumn("text", code_text(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey") % 3))


def x_code(spark, sf_dir) -> DataFrame:
    return x_code_rows(spark, sf_dir).select("path", "line_no", "text")


def x_code_findings(spark, sf_dir) -> DataFrame:
    rule = F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string"))
    rows = x_code_rows(spark, sf_dir).where("l_quantity > 45")
    return rows.select("path", F.col("line_no").alias("line"), rule.alias("rule"))


def x_rule_meta(spark, sf_dir) -> DataFrame:
    """Rules r0 to r4, from the suppliers; the even ones need context, r4 is unknown."""
    k = F.col("s_suppkey") % 5
    s = table(spark, sf_dir, "supplier").where(k < 4)
    return s.select(F.concat(F.lit("r"), k.cast("string")).alias("rule"), (k % 2 == 0).alias("needs_context")).distinct()


def x_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 11 == 0, F.lit(".test.ets")).otherwise(F.lit(".ets"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return d.select(path.alias("path"), "doc_id", "source", F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("content"))


def x_pairs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("repair", F.lead("text").over(w)).where("role = 'user' and repair is not null")
    return rows.select("conv_id", "turn", F.concat(F.lit("rule"), (F.col("conv_id") % 5).cast("string"), F.lit("_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("problem"), "repair")


def x_vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("rule"), F.col("embedding").cast("array<double>").alias("vec"))


def x_queries(spark, sf_dir) -> DataFrame:
    return x_vectors(spark, sf_dir).where("id % 10 = 0").withColumnsRenamed({"id": "qid", "vec": "qvec"})


def x_replies(spark, sf_dir) -> DataFrame:
    p, i = F.col("props"), F.col("event_id").cast("string")
    fence = F.lit("```")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Answer:\n"), fence, F.lit("json\n"), p, F.lit("\n"), fence, F.lit("\nend")))
        .when(F.col("event_type") == "click", p)
        .when(F.col("event_type") == "error", F.concat(fence, F.lit("json\n{\"k\": \n"), fence))
        .when(F.col("event_type") == "signup", F.concat(F.lit("see\n"), fence, F.lit("typescript\nlet a = "), i, F.lit(";\n-old\n+new\n"), fence, F.lit("\nand\n"), fence, F.lit("js\nb();\n"), fence))
        .otherwise(F.concat(F.lit("plain "), i, F.lit("\n-gone\n+added\nkept")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), text.alias("text"))


def x_verdicts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("key"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("attempt"), (F.col("event_type") == "purchase").alias("success"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"))
    return rows.where("attempt <= 3")


def _edges(spark, sf_dir, priority: str, condition: str) -> DataFrame:
    n = customers(spark, sf_dir)
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority).where(condition)
    return o.select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7919 + 13, F.lit(n)).cast("long").alias("dst")).distinct()


def x_edges_half(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir, "1-URGENT", "o_orderkey % 2 = 0")


def x_edges_full(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir, "1-URGENT", "true")


def x_nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))


def x_block_rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("*", F.col("l_orderkey").alias("method"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("block"))


def x_blocks(spark, sf_dir) -> DataFrame:
    return x_block_rows(spark, sf_dir).select("method", "block")


def x_methods_once(spark, sf_dir) -> DataFrame:
    """The rows of x_blocks, x_cfg (targets as a list, tos) and x_stmts as one stored table, so that items are sorted once."""
    r = x_block_rows(spark, sf_dir).withColumn("last", F.max("block").over(W.partitionBy("method")))
    return stored(r.select("method", "block", F.filter(_targets(), lambda t: t <= F.col("last")).alias("tos"), *_names()), "methods")


def _targets() -> Column:
    """Where a block leads; null for no target."""
    ro, a = "l_returnflag = 'R' and l_linestatus = 'O'", "l_returnflag = 'A'"
    b = F.col("block")
    return F.array(F.when(~F.expr(ro), b + 1), F.when(F.expr(f"{a} or {ro}"), b + 2), F.when(F.expr("l_returnflag = 'N' and l_linestatus = 'O'"), F.greatest(F.lit(1), b - 2)))


def _names() -> list[Column]:
    return [F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("def"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("use")]


def x_cfg(spark, sf_dir) -> DataFrame:
    r = x_block_rows(spark, sf_dir).withColumn("last", F.max("block").over(W.partitionBy("method")))
    rows = r.select("method", F.col("block").alias("src"), F.explode(_targets()).alias("dst"), "last").where("dst <= last")
    return rows.select("method", "src", "dst").distinct()


def x_stmts(spark, sf_dir) -> DataFrame:
    return x_block_rows(spark, sf_dir).select("method", "block", *_names())


def x_code_statements(spark, sf_dir) -> DataFrame:
    """method, block, idx, def, use, tos: the items of eight orders in blocks of five; tos: where a block's first item leads."""
    li = table(spark, sf_dir, "lineitem").withColumn("method", F.floor(F.col("l_orderkey") / 8).cast("long"))
    rn = F.row_number().over(W.partitionBy("method").orderBy(*LINE_ORDER)) - 1
    var = lambda c: F.concat(F.lit("v"), (F.col(c) % 4).cast("string"))
    b = F.col("block")
    tos = F.array_compact(F.array(b + 1, F.when(F.col("l_returnflag") == "A", b + 2), F.when(F.col("l_linestatus") == "O", F.greatest(F.lit(1), b - 2))))
    rows = li.withColumn("_rn", rn).withColumn("block", F.floor(F.col("_rn") / 5).cast("int") + 1)
    return rows.select("method", "block", (F.col("_rn") % 5).cast("int").alias("idx"), var("l_suppkey").alias("def"), var("l_partkey").alias("use"), tos.alias("tos"))


def x_flow_rows(spark, sf_dir) -> DataFrame:
    """A statement for each line item: variables and fields by its numbers, calls in second blocks.

    Of eight methods in a row each but the last calls the next; the first is an entry.
    """
    r = x_block_rows(spark, sf_dir)
    m, b = F.col("method"), F.col("block")
    var = lambda c: F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))
    calls = (b == 2) & (m % 8 != 7)
    flag = F.col("l_returnflag")
    return r.select(
        m.cast("long").alias("method"), b.alias("block"), (m * 1000 + b).cast("long").alias("node"), calls.alias("calls"), var("l_suppkey").alias("def_base"),
        F.when((flag == "A") & ~calls, "f").otherwise("").alias("def_field"), var("l_partkey").alias("use_base"), F.when((flag == "N") & ~calls, "f").otherwise("").alias("use_field"), F.col("l_quantity").alias("quantity"),
    )


def x_flow(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a Program, and its statements with their quantities."""
    rows = stored(x_flow_rows(spark, sf_dir))
    methods = rows.groupBy("method").agg(F.max("node").alias("last")).withColumn("first", (F.col("method") * 1000 + 1))
    node = lambda c: (F.col("method") * 1000 + F.col(c)).cast("long")
    calls = rows.where("calls").select("node", (F.col("method") + 1).alias("method")).join(methods, "method").select("node", F.col("first").alias("callee"))
    return {
        "statements": rows.select("node", "def_base", "def_field", "use_base", "use_field"),
        "after": x_cfg(spark, sf_dir).select(node("src").alias("node"), node("dst").alias("to")),
        "calls": calls,
        "args": rows.where("calls").select("node", F.lit(0).alias("pos"), F.col("use_base").alias("value")),
        "params": methods.select(F.col("first").alias("callee"), F.lit(0).alias("pos"), F.lit("v0").alias("name")),
        "exits": methods.select(F.col("first").alias("callee"), F.col("last").alias("node"), F.lit("v1").alias("value")),
        "entries": methods.where("method % 8 = 0").select(F.col("first").alias("node")),
        "procedures": rows.select((F.col("method") * 1000 + 1).alias("start"), "node"),
    }, rows


def x_extends(spark, sf_dir) -> DataFrame:
    """child, parent: customer below nation below region."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).union(c.select(name("c", "c_custkey"), name("n", "c_nationkey")))


def x_classes(spark, sf_dir) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("class")
    rows = [r.select(name("r", "r_regionkey"), F.lit(True).alias("abstract")), n.select(name("n", "n_nationkey"), F.lit(False).alias("abstract")), c.select(name("c", "c_custkey"), F.lit(False).alias("abstract"))]
    return reduce(DataFrame.union, rows)


def x_methods(spark, sf_dir) -> DataFrame:
    """class, name, abstract: each customer has one method, each region declares them all."""
    r, c = table(spark, sf_dir, "region"), table(spark, sf_dir, "customer")
    names = c.select(F.col("c_mktsegment").alias("name")).distinct()
    own = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("class"), F.col("c_mktsegment").alias("name"), F.lit(False).alias("abstract"))
    declared = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("class")).join(F.broadcast(names)).withColumn("abstract", F.lit(True))
    return own.union(declared)


def x_sites(spark, sf_dir) -> DataFrame:
    n = customers(spark, sf_dir)
    o, c, na = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("n_nationkey"))
    rows = o.join(F.broadcast(na), "n_nationkey").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name")), "o_custkey")
    cls = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return rows.select(F.col("o_orderkey").alias("site"), cls("c", F.col("o_custkey")).alias("caller"), cls("r", F.col("n_regionkey")).alias("declared"), "name", cls("c", F.pmod(F.col("o_orderkey"), F.lit(n))).alias("creates"))


def x_pag(spark, sf_dir) -> DataFrame:
    """src, dst, kind, field: address obj -> var, copy, load and write edges."""
    n = customers(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).cast("long").alias("src"), F.pmod(F.col("s_suppkey"), F.lit(n)).cast("long").alias("dst"), F.lit("address").alias("kind"), F.lit(0).cast("long").alias("field"))
    copy = x_edges_half(spark, sf_dir).select("src", "dst", F.lit("copy").alias("kind"), F.lit(0).cast("long").alias("field"))
    high = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'")
    rest = high.select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7919 + 13, F.lit(n)).cast("long").alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("write")).otherwise(F.lit("load")).alias("kind"), (F.floor(F.col("o_orderkey") / 2) % 2).cast("long").alias("field"))
    return s.union(copy).union(rest).distinct()


def x_program(spark, sf_dir) -> dict[str, DataFrame]:
    """Every order is a statement of its customer's method, of a kind by its priority.

    A method has four variables (its number times four, and up): receiver, parameter, local and
    returned value. Eight methods in a row are a module, and call each other only.
    """
    n = customers(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    long = lambda c: c.cast("long")
    module = m - m % 8
    rows = o.select(
        long(k).alias("site"), long(m).alias("method"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), long(m * 4 + k % 4).alias("v"), long(m * 4 + F.floor(k / 4) % 4).alias("w"),
        F.least(long(module + (k * 7919 + 13) % 8), F.lit(n - 1).cast("long")).alias("callee"), long(F.floor(k / 2) % 2).alias("field"), (k % 3).cast("int").alias("name"),
    )
    p, none = F.col("p"), F.lit(None).cast("long")
    kind = F.when(p == 3, "write").when(p == 4, "load").when((p == 5) & (F.col("site") % 2 == 1), "copy").when(p == 5, "address")
    src = F.when(kind == "address", F.col("site")).when(kind == "write", F.col("w")).otherwise(F.col("v"))
    dst = F.when(kind.isin("address", "write"), F.col("v")).otherwise(F.col("w"))
    calls = rows.where(p <= 2)
    made = rows.where((p == 5) & (F.col("site") % 2 == 0))
    each = made.withColumn("name", F.explode(F.array(F.lit(0), F.lit(1))))
    methods = table(spark, sf_dir, "customer").select(long(F.col("c_custkey")).alias("callee"))
    return {
        "statements": rows.where(kind.isNotNull()).select("method", kind.alias("kind"), src.alias("src"), dst.alias("dst"), "field"),
        "calls": calls.select("site", "method", F.when(p == 1, F.col("callee")).alias("callee"), F.when(p == 2, F.col("v")).alias("base"), F.when(p == 2, F.col("name")).alias("name"), F.when(F.col("site") % 3 > 0, F.col("w")).alias("result")),
        "args": calls.select("site", F.lit(0).alias("pos"), F.when(p == 1, F.col("v")).otherwise(F.col("w")).alias("value")),
        "params": methods.select("callee", F.explode(F.array(F.struct(F.lit(-1).alias("pos"), (F.col("callee") * 4).alias("name")), F.struct(F.lit(0).alias("pos"), (F.col("callee") * 4 + 1).alias("name")))).alias("x")).select("callee", "x.*"),
        "returns": methods.select("callee", (F.col("callee") * 4 + 3).alias("value")),
        "dispatch": each.select(F.col("site").alias("obj"), "name", F.least(F.col("method") - F.col("method") % 8 + (F.col("site") + F.col("name")) % 8, F.lit(n - 1).cast("long")).alias("callee")),
        "entries": table(spark, sf_dir, "customer").where("c_acctbal < 0").select(long(F.col("c_custkey")).alias("method")),
    }


def x_tree(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("root"), F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).cast("long").alias("parent"), F.col("role").alias("kind"), F.concat(F.lit("s"), (F.length("text") % 5).cast("string")).alias("state"))


def x_tree_ops(spark, sf_dir) -> DataFrame:
    """root, ord, op, name, callee: four conversations are one build method's calls.

    Of five methods in a row the first three call the fourth, and that one the last.
    """
    c = table(spark, sf_dir, "conversations")
    n, root = F.length("text"), F.floor(F.col("conv_id") / 4).cast("long")
    name = F.element_at(F.array(*map(F.lit, ("Column", "Text", "If", "Row", "Button"))), (n % 5 + 1).cast("int"))
    rows = c.select(root.alias("root"), ((F.col("conv_id") % 4) * 1000 + F.col("turn")).cast("long").alias("ord"), F.col("role").alias("_role"), n.alias("_n"), name.alias("name"))
    made = F.when(F.col("_n") % 7 == 0, F.lit("builder")).when(F.col("_n") % 7 == 1, F.lit("loop")).when(F.col("_n") % 7 == 2, F.lit("component")).otherwise(F.lit("create"))
    op = F.when(F.col("_role") == "assistant", F.lit("pop")).when(F.col("_role") == "system", F.lit("branch")).otherwise(made)
    callee = F.when(F.col("root") % 5 < 3, F.col("root") - F.col("root") % 5 + 3).when(F.col("root") % 5 == 3, F.col("root") + 1)
    return rows.select("root", "ord", op.alias("op"), "name", F.when(op.isin("builder", "loop", "component"), callee).alias("callee"))


def x_exports(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return p.select(F.col("page_id").alias("file"), F.concat(F.lit("m"), (F.col("page_id") % 20).cast("string")).alias("name"), (F.col("page_id") % 4 == 0).alias("is_default"), host.alias("host"))


def x_imports(spark, sf_dir) -> DataFrame:
    """file, ord, name, from: links of each page; names and targets follow the page's number."""
    p = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    rows = p.select(F.col("page_id").alias("file"), F.posexplode(links).alias("ord", "href"))
    return rows.select("file", "ord", F.concat(F.lit("m"), ((F.col("file") * 3 + F.col("ord")) % 20).cast("string")).alias("name"), "href", F.floor(F.col("file") / 2).cast("long").alias("target"))


def x_tokens(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.split("text", " ").alias("tokens"))


SQL = {
    "n": "SELECT count(*) AS n FROM customer",
    "x_findings": r"""SELECT event_id, CAST(least(floor((day(ts) - 1) / 5), 5) AS INTEGER) AS round, user_id AS file, event_type AS rule, CAST(event_id % 40 + 1 AS INTEGER) AS line, props AS detail,
        'C:\x\' || CASE WHEN floor((day(ts) - 1) / 5) = 0 THEN 'origin' ELSE 'round_' || CAST(CAST(floor((day(ts) - 1) / 5) AS INTEGER) AS VARCHAR) || CASE WHEN event_id % 10 = 0 THEN '_reject' ELSE '' END END || '\proj' || CAST(user_id % 7 AS VARCHAR) || '\ets\f' || CAST(user_id AS VARCHAR) || '.ets' AS path FROM events""",
    "x_ranges": 'SELECT user_id AS path, event_id AS id, event_id % 2000 + 1 AS start, event_id % 2000 + 1 + event_id % 5 AS "end" FROM events',
    "x_code_rows": """SELECT *, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '  Column() {' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '  for (let i = 0; i < 3; i++) {'
        WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '  @State v' || CAST(l_partkey % 3 AS VARCHAR) || ': number = 0;' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '  this.v' || CAST(l_partkey % 3 AS VARCHAR) || ' += 1;' ELSE '  }' END AS text
        FROM (SELECT *, l_orderkey // 16 AS path, CAST(row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS line_no FROM lineitem)""",
    "x_code": "SELECT path, line_no, text FROM x_code_rows",
    "x_code_findings": "SELECT path, line_no AS line, 'r' || CAST(l_suppkey % 5 AS VARCHAR) AS rule FROM x_code_rows WHERE l_quantity > 45",
    "x_rule_meta": "SELECT DISTINCT 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS rule, (s_suppkey % 5) % 2 = 0 AS needs_context FROM supplier WHERE s_suppkey % 5 < 4",
    "x_docs": "SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '.test.ets' ELSE '.ets' END AS path, doc_id, source, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS content FROM documents",
    "x_pairs": "SELECT conv_id, turn, 'rule' || CAST(conv_id % 5 AS VARCHAR) || '_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS key, text AS problem, repair FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS repair FROM conversations) WHERE role = 'user' AND repair IS NOT NULL",
    "x_vectors": "SELECT vec_id AS id, label AS rule, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "x_queries": "SELECT id AS qid, rule, vec AS qvec FROM x_vectors WHERE id % 10 = 0",
    "x_replies": """SELECT event_id AS key, CASE event_type WHEN 'view' THEN 'Answer:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'end' WHEN 'click' THEN props WHEN 'error' THEN '```json' || chr(10) || '{"k": ' || chr(10) || '```'
        WHEN 'signup' THEN 'see' || chr(10) || '```typescript' || chr(10) || 'let a = ' || CAST(event_id AS VARCHAR) || ';' || chr(10) || '-old' || chr(10) || '+new' || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```js' || chr(10) || 'b();' || chr(10) || '```'
        ELSE 'plain ' || CAST(event_id AS VARCHAR) || chr(10) || '-gone' || chr(10) || '+added' || chr(10) || 'kept' END AS text FROM events""",
    "x_verdicts": "SELECT * FROM (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS attempt, event_type = 'purchase' AS success, 't' || CAST(event_id AS VARCHAR) AS text FROM events) WHERE attempt <= 3",
    "x_edges_half": "SELECT DISTINCT o_custkey AS src, (o_orderkey * 7919 + 13) % n AS dst FROM orders, n WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0",
    "x_edges_full": "SELECT DISTINCT o_custkey AS src, (o_orderkey * 7919 + 13) % n AS dst FROM orders, n WHERE o_orderpriority = '1-URGENT'",
    "x_nodes": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind FROM customer",
    "x_block_rows": "SELECT *, l_orderkey AS method, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS block FROM lineitem",
    "x_blocks": "SELECT method, block FROM x_block_rows",
    "x_cfg": """SELECT DISTINCT method, src, dst FROM (
        SELECT method, block AS src, unnest([CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O') THEN block + 1 END, CASE WHEN l_returnflag = 'A' OR l_returnflag = 'R' AND l_linestatus = 'O' THEN block + 2 END, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN greatest(1, block - 2) END]) AS dst, last
        FROM (SELECT *, max(block) OVER (PARTITION BY method) AS last FROM x_block_rows)) WHERE dst <= last""",
    "x_stmts": "SELECT method, block, 'v' || CAST(l_suppkey % 3 AS VARCHAR) AS def, 'v' || CAST(l_partkey % 3 AS VARCHAR) AS use FROM x_block_rows",
    "x_code_statements": """SELECT method, CAST(rn // 5 + 1 AS INTEGER) AS block, CAST(rn % 5 AS INTEGER) AS idx, 'v' || CAST(l_suppkey % 4 AS VARCHAR) AS def, 'v' || CAST(l_partkey % 4 AS VARCHAR) AS use,
        list_filter([CAST(rn // 5 + 2 AS INTEGER), CASE WHEN l_returnflag = 'A' THEN CAST(rn // 5 + 3 AS INTEGER) END, CASE WHEN l_linestatus = 'O' THEN CAST(greatest(1, rn // 5 - 1) AS INTEGER) END], lambda x: x IS NOT NULL) AS tos
        FROM (SELECT *, l_orderkey // 8 AS method, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS rn FROM lineitem)""",
    "x_flow": """SELECT method, block, method * 1000 + block AS node, block = 2 AND method % 8 <> 7 AS calls, 'v' || CAST(l_suppkey % 3 AS VARCHAR) AS db, CASE WHEN l_returnflag = 'A' AND NOT (block = 2 AND method % 8 <> 7) THEN 'f' ELSE '' END AS df,
        'v' || CAST(l_partkey % 3 AS VARCHAR) AS ub, CASE WHEN l_returnflag = 'N' AND NOT (block = 2 AND method % 8 <> 7) THEN 'f' ELSE '' END AS uf, l_quantity AS q FROM x_block_rows""",
    "x_extends": "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS child, 'r' || CAST(n_regionkey AS VARCHAR) AS parent FROM nation UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer",
    "x_classes": "SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS class, true AS abstract FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), false FROM nation UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), false FROM customer",
    "x_methods": "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS class, c_mktsegment AS name, false AS abstract FROM customer UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), name, true FROM region, (SELECT DISTINCT c_mktsegment AS name FROM customer)",
    "x_sites": "SELECT o_orderkey AS site, 'c' || CAST(o_custkey AS VARCHAR) AS caller, 'r' || CAST(n_regionkey AS VARCHAR) AS declared, c_mktsegment AS name, 'c' || CAST(o_orderkey % n AS VARCHAR) AS creates FROM orders, n, nation, customer WHERE o_orderkey % 2 = 0 AND n_nationkey = o_orderkey % 25 AND c_custkey = o_custkey",
    "x_pag": """SELECT -s_suppkey - 1 AS src, s_suppkey % n AS dst, 'address' AS kind, 0 AS field FROM supplier, n UNION SELECT src, dst, 'copy', 0 FROM x_edges_half
        UNION SELECT o_custkey, (o_orderkey * 7919 + 13) % n, CASE WHEN o_orderkey % 2 = 0 THEN 'write' ELSE 'load' END, (o_orderkey // 2) % 2 FROM orders, n WHERE o_orderpriority = '2-HIGH'""",
    "x_program": """SELECT o_orderkey AS site, o_custkey AS method, CAST(o_orderpriority[1] AS INTEGER) AS p, o_custkey * 4 + o_orderkey % 4 AS v, o_custkey * 4 + (o_orderkey // 4) % 4 AS w, least(o_custkey - o_custkey % 8 + (o_orderkey * 7919 + 13) % 8, n - 1) AS callee, (o_orderkey // 2) % 2 AS field, o_orderkey % 3 AS name, o_orderkey % 2 AS odd, n FROM orders, n""",
    "x_tree": "SELECT conv_id AS root, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role AS kind, 's' || CAST(length(text) % 5 AS VARCHAR) AS state FROM conversations",
    "x_tree_ops": """SELECT root, ord, op, name, CASE WHEN op IN ('builder', 'loop', 'component') THEN CASE WHEN root % 5 < 3 THEN root - root % 5 + 3 WHEN root % 5 = 3 THEN root + 1 END END AS callee FROM (
        SELECT conv_id // 4 AS root, (conv_id % 4) * 1000 + turn AS ord, CASE WHEN role = 'assistant' THEN 'pop' WHEN role = 'system' THEN 'branch' WHEN length(text) % 7 = 0 THEN 'builder' WHEN length(text) % 7 = 1 THEN 'loop' WHEN length(text) % 7 = 2 THEN 'component' ELSE 'create' END AS op,
        ['Column', 'Text', 'If', 'Row', 'Button'][length(text) % 5 + 1] AS name FROM conversations)""",
    "x_exports": "SELECT page_id AS file, 'm' || CAST(page_id % 20 AS VARCHAR) AS name, page_id % 4 = 0 AS is_default, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages",
    "x_imports": """SELECT file, CAST(o AS INTEGER) AS ord, 'm' || CAST((file * 3 + o) % 20 AS VARCHAR) AS name, hrefs[o + 1] AS href, file // 2 AS target FROM (SELECT page_id AS file, hrefs, unnest(range(len(hrefs))) AS o FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs FROM pages))""",
    "x_tokens": "SELECT doc_id AS path, string_split(text, ' ') AS tokens FROM documents",
}
NEEDS = {"x_code": ("x_code_rows",), "x_code_findings": ("x_code_rows",), "x_queries": ("x_vectors",), "x_edges_half": ("n",), "x_edges_full": ("n",), "x_blocks": ("x_block_rows",), "x_cfg": ("x_block_rows",), "x_stmts": ("x_block_rows",), "x_sites": ("n",), "x_pag": ("n", "x_edges_half"), "x_program": ("n",), "x_flow": ("x_block_rows", "x_cfg")}


def sql(*names: str, body: str, recursive: bool = False, more: str = "") -> str:
    """An oracle statement: the stand-ins it names, with what they need, then body."""
    out: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    ctes = [f"{x} AS ({SQL[x]})" for x in out] + ([more] if more else [])
    head = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n") if ctes else ""
    return head + body
