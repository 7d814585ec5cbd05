"""Joins of findings, rules, files, ranges, imports and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.plans.fixpoint import fixpoint

BUCKET = 1024  # positions; ranges meet in the buckets they touch


def build_rules(bad: DataFrame, good: DataFrame) -> DataFrame:
    """Bad pages with the good page of the same stem, null where there is none."""
    return bad.join(good.select("stem", F.col("example").alias("good_example")), "stem", "left")


def with_rule_meta(findings: DataFrame, meta: DataFrame) -> DataFrame:
    """Findings of unknown rules are dropped. Spark broadcasts meta if it is small."""
    return findings.join(meta, "rule")


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def match_report_to_file(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Reports whose path ends with the file's name: equal base names, then the suffix."""
    base = lambda p: F.substring_index(_slashes(p), "/", -1)
    r = reports.withColumn("_base", base(F.col("path")))
    f = files.withColumn("_base", base(F.col("name")))
    return r.join(f, "_base").where(F.endswith(_slashes(F.col("path")), _slashes(F.col("name")))).drop("_base")


def match_report_to_relpath(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Reports whose path contains the file's relative path."""
    base = lambda p: F.substring_index(_slashes(p), "/", -1)
    r = reports.withColumn("_base", base(F.col("path")))
    f = files.withColumn("_base", base(F.col("relative")))
    return r.join(f, "_base").where(F.contains(_slashes(F.col("path")), _slashes(F.col("relative")))).drop("_base")


def pending(files: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    return files.join(processed, key, "left_anti")


def pair_examples(problems: DataFrame, repairs: DataFrame) -> DataFrame:
    return problems.join(repairs, "key")


def _buckets(start: Column, end: Column, size: int = BUCKET) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def node_token_span(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """path, node, first, last: the tokens (tok) that overlap each node's characters."""
    n = nodes.where(F.col("end") > F.col("start")).withColumn("_b", _buckets(F.col("start"), F.col("end") - 1))
    t = tokens.select("path", "tok", F.col("start").alias("ts"), F.col("end").alias("te")).withColumn("_b", _buckets(F.col("ts"), F.col("te") - 1))
    rows = n.join(t, ["path", "_b"]).where((F.col("te") > F.col("start")) & (F.col("ts") < F.col("end")))
    return rows.groupBy("path", "node").agg(F.min("tok").alias("first"), F.max("tok").alias("last"))


def overlapping_findings(ranges: DataFrame) -> DataFrame:
    """a, b: pairs of one path whose ranges overlap or touch; each pair once."""
    rows = ranges.select("path", "id", "start", "end").withColumn("_b", _buckets(F.col("start"), F.col("end") + 1))
    other = rows.select("path", "_b", F.col("id").alias("b"), F.col("start").alias("bs"), F.col("end").alias("be"))
    both = rows.withColumnRenamed("id", "a").join(other, ["path", "_b"])
    meet = (F.col("end") + 1 >= F.col("bs")) & (F.col("be") + 1 >= F.col("start")) & (F.col("a") < F.col("b"))
    home = F.col("_b") == F.floor(F.greatest("start", "bs") / BUCKET)  # one of the shared buckets
    return both.where(meet & home).select("path", "a", "b").distinct()


def outside_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines that lie in no block (head, end) of their file.

    One pass in order of lines: a line is inside if an end so far isn't before it. Blocks
    come before the line that they begin at.
    """
    row = F.struct(*lines.columns)
    begin = blocks.select("path", F.col("head").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"), F.lit(None).cast(lines.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    own = lines.select("path", F.col("line_no").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), row.alias("_row"))
    upto = W.partitionBy("path").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = begin.union(own).withColumn("_past", F.max("_end").over(upto))
    return both.where("_kind = 1 and (_past is null or _past < _at)").select("_row.*")


def held_in(points: DataFrame, blocks: DataFrame, inner: bool = False) -> DataFrame:
    """path, line, head, end: the block with the smallest head that holds each point (path, line).

    inner: the block with the largest head before the line instead. Blocks are cut into
    cells of BUCKET lines. Of blocks that cover the same lines of a cell only the one that
    goes first is kept, so a cell has few rows however many blocks cross it.
    """
    best, first = (F.max, F.col("head") + 1) if inner else (F.min, F.col("head"))
    cells = blocks.select("path", "head", "end", F.explode(F.sequence(F.floor(F.col("head") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("_b"))
    low, high = F.greatest(first, F.col("_b") * BUCKET), F.least("end", (F.col("_b") + 1) * BUCKET - 1)
    cells = cells.where(F.col("end") >= F.col("head")).groupBy("path", "_b", low.alias("_low"), high.alias("_high")).agg(best(F.struct("head", "end")).alias("_block"))
    at = points.select("path", "line").distinct().withColumn("_b", F.floor(F.col("line") / BUCKET))
    rows = at.join(cells, ["path", "_b"]).where(F.col("line").between(F.col("_low"), F.col("_high")))
    return rows.groupBy("path", "line").agg(best("_block").alias("_block")).select("path", "line", "_block.*")


def resolve_imports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """file, ord, name, found: the file whose export an import means.

    In the target file an export of the name comes first, then one flagged default; failing
    both, the import is followed through the target's own imports of that name.
    """
    seed = imports.select("file", "ord", "name", F.col("target").alias("at"), F.lit(0).alias("hop"))
    onward = imports.select(F.col("file").alias("at"), "name", F.col("target").alias("_to")).distinct()

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        return delta.join(onward, ["at", "name"]).select("file", "ord", "name", F.col("_to").alias("at"), (F.col("hop") + 1).alias("hop"))

    walk = fixpoint(seed, step, ["file", "ord", "at"])
    e = exports.select(F.col("file").alias("at"), F.col("name").alias("own"), "is_default")
    hits = walk.join(e, "at").withColumn("rank", F.when(F.col("own") == F.col("name"), F.col("hop") * 2).when(F.col("is_default") & (F.col("hop") == 0), F.lit(1)))
    hits = hits.where("rank is not null")
    best = hits.groupBy("file", "ord", "name").agg(F.min_by("at", F.struct("rank", "at")).alias("found"))
    return imports.select("file", "ord", "name").join(best, ["file", "ord", "name"], "left")


#: Kinds of exported items, in the order in which they are looked for.
ITEM_ORDER = ("class", "function", "namespace", "local", "alias")


def resolve_items(imports: DataFrame, exports: DataFrame, declared: DataFrame) -> DataFrame:
    """file, ord, name, found (a file), item (its kind), hops: what each import means.

    imports: file, ord, name, kind (named, default or star), target; exports: file, name, item,
    is_default; declared: file, name, item of declaration files, which needn't export what
    they declare. A star means the whole target. Else the target is searched, then what it
    imports by the same name in its turn: nearest first, in a file an export of that name, for
    default imports then one flagged default, then a declared item; among these by ITEM_ORDER.
    """
    seed = imports.where("kind <> 'star'").select("file", "ord", "name", "kind", F.col("target").alias("at"), F.lit(0).alias("hops"))
    onward = imports.where("kind <> 'star'").select(F.col("file").alias("at"), "name", F.col("target").alias("_to")).distinct()

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        return delta.join(onward, ["at", "name"]).select("file", "ord", "name", "kind", F.col("_to").alias("at"), (F.col("hops") + 1).alias("hops"))

    walk = fixpoint(seed, step, ["file", "ord", "at"])
    has = exports.select(F.col("file").alias("at"), F.col("name").alias("_own"), "item", "is_default", F.lit(0).alias("_tier"))
    has = has.union(declared.select("file", "name", "item", F.lit(False), F.lit(2)))
    tier = F.when(F.col("_own") == F.col("name"), F.col("_tier")).when(F.col("is_default") & (F.col("kind") == "default"), F.lit(1))
    hits = walk.join(has, "at").withColumn("_rank", tier).where("_rank is not null")
    order = F.array_position(F.array(*map(F.lit, ITEM_ORDER)), F.col("item"))
    best = hits.groupBy("file", "ord").agg(F.min(F.struct("hops", "_rank", order.alias("_order"), "at", "item")).alias("_b"))
    rows = imports.select("file", "ord", "name", "kind", "target").join(best, ["file", "ord"], "left")
    star = F.col("kind") == "star"
    return rows.select("file", "ord", "name", F.when(star, F.col("target")).otherwise(F.col("_b.at")).alias("found"), F.when(star, "file").otherwise(F.col("_b.item")).alias("item"), F.when(star, 0).otherwise(F.col("_b.hops")).alias("hops"))


#: Prefixes of system modules and the folder each means.
SYSTEM_FOLDERS = (("@ohos.", "api"), ("@kit.", "kits"), ("@arkts.", "arkts"))


def resolve_module_paths(imports: DataFrame, files: DataFrame, packages: DataFrame, mapping: DataFrame) -> DataFrame:
    """imports (id, folder, from) with path: the known file (path) that each text means.

    Relative texts: the file with a suffix, else the folder's index; packages (name, main)
    by the part before src or index; system prefixes by folder; mapping (prefix, to) for
    configured prefixes. Candidates have a rank; the first known one wins.
    """
    text = F.col("from")
    kind = F.when(text.startswith("."), "relative").when(text.startswith("@"), "system").otherwise("name")
    rows = imports.withColumn("_kind", kind)
    up = F.regexp_replace("folder", r"/?[^/]*$", "")
    base = F.when(text.startswith("../"), F.concat_ws("/", F.nullif(up, F.lit("")), F.substring(text, 4, 1 << 20))).otherwise(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.substring(text, 3, 1 << 20)))
    ends = F.array(F.lit(".ets"), F.lit(".ts"), F.lit(".d.ts"), F.lit("/index.ets"), F.lit("/index.ts"))
    relative = rows.where("_kind = 'relative'").withColumn("_base", base).select("id", F.posexplode(F.transform(ends, lambda e: F.concat(F.col("_base"), e))).alias("rank", "path"))
    folder = F.lit(None).cast("string")
    for prefix, name in SYSTEM_FOLDERS:
        folder = F.when(text.startswith(prefix), F.lit(name)).otherwise(folder)
    system = rows.where("_kind = 'system'").select("id", F.lit(0).alias("rank"), F.concat(folder, F.lit("/"), text, F.lit(".d.ts")).alias("path"))
    name = F.regexp_replace(text, r"/(?:src|index)(?:/.*)?$", "")
    named = rows.where("_kind = 'name'").withColumn("name", name).join(packages, "name").select("id", F.posexplode(F.array(F.concat("name", F.lit("/"), "main"), F.concat("name", F.lit("/index.ets")))).alias("rank", "path"))
    # prefixes end at a slash, so the first part of the text is the key
    key = F.concat(F.substring_index(text, "/", 1), F.lit("/"))
    mapped = rows.where("_kind = 'name'").withColumn("prefix", key).join(mapping, "prefix").select("id", F.lit(9).alias("rank"), F.concat("to", F.expr("substring(`from`, length(prefix) + 1)"), F.lit(".ets")).alias("path"))
    found = relative.union(system).union(named).union(mapped).join(files.select("path"), "path", "left_semi")
    best = found.groupBy("id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return imports.join(best, "id", "left")


def keep_supported(findings: DataFrame, retrieved: DataFrame, key: str = "rule") -> DataFrame:
    return findings.join(retrieved, key, "left_semi")


def match_methods(spec: DataFrame, methods: DataFrame, default: str = "_default") -> DataFrame:
    """Methods that a source or sink spec names by class and name; class _ is the default."""
    wanted = spec.select(F.when(F.col("class") == "_", F.lit(default)).otherwise(F.col("class")).alias("class"), "name", "role")
    return methods.join(wanted, ["class", "name"])


def match_signatures(spec: DataFrame, methods: DataFrame, default: str = "_default") -> DataFrame:
    """spec's columns with the method that each row names; rows that name none are dropped.

    spec: file, namespace, class, name, params, role; methods: method, file, namespace, class, name,
    params. A namespace _ is the file itself (null in methods), a class _ is the default class.
    params is an array of "name:type" that must be equal, null for any; without it the
    first method of that name counts, by its params and key. Methods of one signature are one row
    before they meet spec, so a row of spec meets one at most.
    """
    wanted = spec.select("file", F.when(F.col("namespace") != "_", F.col("namespace")).alias("_ns"), F.when(F.col("class") == "_", F.lit(default)).otherwise(F.col("class")).alias("_class"), "name", F.col("params").alias("_params"), F.struct(*spec.columns).alias("_spec")).distinct()
    have = methods.select(F.col("method"), F.col("file").alias("_file"), F.col("namespace").alias("_ns_has"), F.col("class").alias("_class_has"), F.col("name").alias("_name"), F.col("params").alias("_has"))
    place, first = ["_file", "_ns_has", "_class_has", "_name"], F.min_by("method", F.struct("_has", "method")).alias("method")
    exact = have.groupBy(*place, "_has").agg(first)
    any_ = exact.groupBy(*place).agg(first).withColumn("_has", F.lit(None).cast(methods.schema["params"].dataType))
    known = exact.where("_has is not null").unionByName(any_)
    same = (F.col("file") == F.col("_file")) & (F.col("_class") == F.col("_class_has")) & (F.col("name") == F.col("_name"))
    rows = wanted.join(known, same & F.col("_ns").eqNullSafe(F.col("_ns_has")) & F.col("_params").eqNullSafe(F.col("_has")))
    return rows.select("_spec.*", "method")


def visible_names(scopes: DataFrame, names: DataFrame, imports: DataFrame) -> DataFrame:
    """scope, name: what each scope sees: its own, its children's exported, imported, inherited.

    scopes (scope, parent), names (name, scope, exported), imports (scope, source).
    """
    out = names.where("exported").select(F.col("scope").alias("_from"), "name")
    own = names.select("scope", "name")
    below = scopes.where("parent is not null").select(F.col("parent").alias("scope"), F.col("scope").alias("_from")).join(out, "_from").select("scope", "name")
    brought = imports.select("scope", F.col("source").alias("_from")).join(out, "_from").select("scope", "name")
    direct = own.unionByName(below).unionByName(brought).distinct()
    up = scopes.where("parent is not null").select("scope", F.col("parent").alias("above"))
    onward = up.select(F.col("scope").alias("above"), F.col("above").alias("_to"))
    chain = fixpoint(up, lambda d, _: d.join(onward, "above").select("scope", F.col("_to").alias("above")), ["scope", "above"])
    inherited = chain.join(direct.select(F.col("scope").alias("above"), "name"), "above").select("scope", "name")
    return direct.unionByName(inherited).distinct()


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
