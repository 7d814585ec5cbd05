"""Queries of the joins, context, repair, source and streaming operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.columns import ordered_text
from codequarry.operators import context as C
from codequarry.operators import joins as J
from codequarry.operators import repair as Rp
from codequarry.operators import retrieve as R
from codequarry.operators import rounds as Rd
from codequarry.operators import text as T
from codequarry.operators import windows as V
from codequarry.plans import standins as X
from codequarry.plans.fixpoint import new_path
from codequarry.plans.standins import sql
from codequarry.queries.tables import BLOCK, HEAD_PATTERN, ISLANDS, TOP
from codequarry.queries.texts import CODE_FILES, LINES, code_files
from codequarry.sources import io
from codequarry.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def text_of(n: str):
    return F.col(n).cast("string")


# joins


@query("j1_build_rules", sql("x_docs", body="SELECT b.doc_id AS stem, b.content AS example, g.content AS good_example FROM x_docs b LEFT JOIN (SELECT doc_id, content FROM x_docs WHERE doc_id IN (SELECT doc_id FROM labels)) g USING (doc_id)"))
def j1(spark, sf):
    bad = X.x_docs(spark, sf).select(F.col("doc_id").alias("stem"), F.col("content").alias("example"))
    good = bad.join(X.table(spark, sf, "labels").select(F.col("doc_id").alias("stem")), "stem", "left_semi")
    return J.build_rules(bad, good)


@query("j2_with_rule_meta", sql("x_code_findings", "x_rule_meta", body="SELECT path, line, rule, needs_context FROM x_code_findings JOIN x_rule_meta USING (rule)"))
def j2(spark, sf):
    return J.with_rule_meta(X.x_code_findings(spark, sf), X.x_rule_meta(spark, sf)).select("path", "line", "rule", "needs_context")


@query("j3_match_report_to_file", sql("x_findings", body="SELECT event_id, 'f' || CAST(file AS VARCHAR) || '.ets' AS name FROM x_findings WHERE file % 3 <> 0"))
def j3(spark, sf):
    f = X.x_findings(spark, sf)
    files = f.where("file % 3 <> 0").select(F.concat(F.lit("f"), text_of("file"), F.lit(".ets")).alias("name")).distinct()
    return J.match_report_to_file(f, files).select("event_id", "name")


@query("j4_match_report_to_relpath", sql("x_findings", body=r"SELECT event_id, 'proj' || CAST(file % 7 AS VARCHAR) || '\ets\f' || CAST(file AS VARCHAR) || '.ets' AS relative FROM x_findings WHERE file % 2 = 0"))
def j4(spark, sf):
    f = X.x_findings(spark, sf)
    rel = F.concat(F.lit("proj"), (F.col("file") % 7).cast("string"), F.lit("\\ets\\f"), text_of("file"), F.lit(".ets"))
    return J.match_report_to_relpath(f, f.where("file % 2 = 0").select(rel.alias("relative")).distinct()).select("event_id", "relative")


PENDING = sql("x_docs", body="SELECT path FROM x_docs WHERE doc_id % 3 <> 0")


@query("j5_pending", PENDING)
def j5(spark, sf):
    d = X.x_docs(spark, sf)
    return J.pending(d.select("path"), d.where("doc_id % 3 = 0"))


@query("j6_pair_examples", sql("x_pairs", body="SELECT key, problem, repair FROM x_pairs WHERE conv_id % 3 <> 0 AND turn % 3 <> 1"))
def j6(spark, sf):
    p = X.x_pairs(spark, sf)
    return J.pair_examples(p.where("conv_id % 3 <> 0").select("key", "problem"), p.where("turn % 3 <> 1").select("key", "repair"))


TOKENS = CODE_FILES + r""", tk AS (SELECT path, k AS tok, start, start + length(text) AS stop FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT path, unnest(m) AS text, unnest(range(len(m))) AS k FROM (SELECT path, regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\n|[ \t\r]+|[\s\S]') AS m FROM cf))) WHERE regexp_matches(text, '^[^\s]')),
    nd AS (SELECT path, line_no AS node, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line_no) - length(text) - 1 AS s, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line_no) - 1 AS e FROM x_code)"""


@query("j7_node_token_span", sql("x_code", more=TOKENS, body="SELECT nd.path, node, CAST(min(start) AS BIGINT) AS first, CAST(max(start) AS BIGINT) AS last FROM nd JOIN tk ON tk.path = nd.path AND tk.stop > nd.s AND tk.start < nd.e GROUP BY ALL"))
def j7(spark, sf):
    from pyspark.sql import Window as W

    t = T.tokenize(code_files(spark, sf)).withColumn("tok", F.col("start"))
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(w)
    nodes = X.x_code(spark, sf).select("path", F.col("line_no").alias("node"), (end - F.length("text") - 1).alias("start"), (end - 1).alias("end"))
    return J.node_token_span(nodes, t)


MEET = 'a."end" + 1 >= b.start AND b."end" + 1 >= a.start'


@query("j8_overlapping_findings", sql("x_ranges", body=f"SELECT a.path, a.id AS a, b.id AS b FROM x_ranges a JOIN x_ranges b ON a.path = b.path AND a.id < b.id AND {MEET}"))
def j8(spark, sf):
    return J.overlapping_findings(X.x_ranges(spark, sf))


@query("j9_outside_blocks", sql("x_code", more=BLOCK, body="SELECT path, line_no FROM x_code c WHERE NOT EXISTS (SELECT 1 FROM blk b WHERE b.path = c.path AND c.line_no BETWEEN b.head AND b.stop)"))
def j9(spark, sf):
    lines = X.x_code(spark, sf)
    blocks = C.outermost_only(V.block_end(lines, F.col("text").rlike(HEAD_PATTERN)))
    return J.outside_blocks(lines, blocks).select("path", "line_no")


@query(
    "j10_resolve_imports",
    sql(
        "x_imports",
        "x_exports",
        recursive=True,
        more="w AS (SELECT file, ord, name, target AS at_, 0 AS hop FROM x_imports UNION SELECT w.file, w.ord, w.name, i.target, hop + 1 FROM w JOIN (SELECT DISTINCT file, name, target FROM x_imports) i ON i.file = w.at_ AND i.name = w.name WHERE hop < 30), g AS (SELECT file, ord, name, at_, min(hop) AS hop FROM w GROUP BY ALL), h AS (SELECT g.*, CASE WHEN e.name = g.name THEN hop * 2 WHEN is_default AND hop = 0 THEN 1 END AS rank FROM g JOIN x_exports e ON e.file = at_)",
        body="SELECT i.file, i.ord, i.name, b.found FROM x_imports i LEFT JOIN (SELECT file, ord, name, min_by(at_, (rank, at_)) AS found FROM h WHERE rank IS NOT NULL GROUP BY ALL) b ON b.file = i.file AND b.ord = i.ord AND b.name = i.name",
    ),
)
def j10(spark, sf):
    return J.resolve_imports(X.x_imports(spark, sf), X.x_exports(spark, sf))


ITEMS = """im AS (SELECT file, ord, name, CASE ord % 7 WHEN 0 THEN 'star' WHEN 1 THEN 'default' ELSE 'named' END AS kind, target FROM x_imports), ex AS (SELECT file AS at_, name, ['class', 'function', 'namespace', 'local', 'alias'][file % 5 + 1] AS item, is_default, 0 AS tier FROM x_exports UNION ALL SELECT file, name, ['alias', 'local', 'class', 'function', 'namespace'][file % 5 + 1], false, 0 FROM x_exports WHERE file % 2 = 0
    UNION ALL SELECT file, 'm' || CAST((file + 7) % 20 AS VARCHAR), ['class', 'function', 'namespace', 'local', 'alias'][file % 5 + 1], false, 2 FROM x_exports WHERE file % 3 = 0),
    w AS (SELECT file, ord, name, kind, target AS at_, 0 AS hops FROM im WHERE kind <> 'star' UNION SELECT w.file, w.ord, w.name, w.kind, i.target, hops + 1 FROM w JOIN (SELECT DISTINCT file, name, target FROM im WHERE kind <> 'star') i ON i.file = w.at_ AND i.name = w.name WHERE hops < 30), g AS (SELECT file, ord, name, kind, at_, min(hops) AS hops FROM w GROUP BY ALL),
    h AS (SELECT g.*, e.item, list_position(['class', 'function', 'namespace', 'local', 'alias'], e.item) AS o, CASE WHEN e.name = g.name THEN tier WHEN is_default AND kind = 'default' THEN 1 END AS rank FROM g JOIN ex e ON e.at_ = g.at_)"""


@query(
    "j10_resolve_items",
    sql(
        "x_imports",
        "x_exports",
        recursive=True,
        more=ITEMS,
        body="SELECT i.file, i.ord, i.name, CASE WHEN kind = 'star' THEN target ELSE b.f.at_ END AS found, CASE WHEN kind = 'star' THEN 'file' ELSE b.f.item END AS item, CASE WHEN kind = 'star' THEN 0 ELSE b.f.hops END AS hops FROM im i LEFT JOIN (SELECT file, ord, min_by({'at_': at_, 'item': item, 'hops': hops}, (hops, rank, o, at_)) AS f FROM h WHERE rank IS NOT NULL GROUP BY ALL) b ON b.file = i.file AND b.ord = i.ord",
    ),
)
def j10_items(spark, sf):
    order = ("class", "function", "namespace", "local", "alias")
    kinds = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("file") % 5 + 1).cast("int")).alias("item")
    e = X.x_exports(spark, sf)
    exports = e.select("file", "name", kinds(order), "is_default").union(e.where("file % 2 = 0").select("file", "name", kinds(("alias", "local", "class", "function", "namespace")), F.lit(False)))
    declared = e.where("file % 3 = 0").select("file", F.concat(F.lit("m"), ((F.col("file") + 7) % 20).cast("string")).alias("name"), kinds(order))
    imports = X.x_imports(spark, sf).withColumn("kind", F.when(F.col("ord") % 7 == 0, "star").when(F.col("ord") % 7 == 1, "default").otherwise("named"))
    return J.resolve_items(imports, exports, declared)


IMPORT_TEXT = """CASE ord % 6 WHEN 0 THEN './m' || CAST(ord % 9 AS VARCHAR) WHEN 1 THEN '../p' || CAST(file % 5 AS VARCHAR) || '/m' || CAST(ord AS VARCHAR) WHEN 2 THEN '@ohos.' || name WHEN 3 THEN 'lib' || CAST(file % 4 AS VARCHAR) || '/src/x' WHEN 4 THEN 'cfg/' || name ELSE '@kit.' || name END"""


@query(
    "j11_resolve_module_paths",
    sql(
        "x_imports",
        more=f"i AS (SELECT file * 100 + ord AS id, 'p' || CAST(file % 10 AS VARCHAR) AS folder, {IMPORT_TEXT} AS t FROM x_imports), f AS (SELECT DISTINCT 'p' || CAST(file % 10 AS VARCHAR) || '/m' || CAST(ord AS VARCHAR) || CASE WHEN ord % 2 = 0 THEN '.ets' ELSE '/index.ets' END AS path FROM x_imports UNION SELECT DISTINCT 'api/@ohos.' || name || '.d.ts' FROM x_imports UNION SELECT DISTINCT 'real/' || name || '.ets' FROM x_imports UNION SELECT DISTINCT 'lib' || CAST(file % 4 AS VARCHAR) || '/main.ets' FROM x_imports WHERE file % 4 < 3),"
        " c AS (SELECT id, unnest([0, 1]) AS rank, unnest([b || '.ets', b || '/index.ets']) AS path FROM (SELECT id, CASE WHEN starts_with(t, '../') THEN substr(t, 4) ELSE folder || '/' || substr(t, 3) END AS b FROM i WHERE starts_with(t, '.')) UNION ALL SELECT id, 0, CASE WHEN starts_with(t, '@ohos.') THEN 'api/' ELSE 'kits/' END || t || '.d.ts' FROM i WHERE starts_with(t, '@') UNION ALL SELECT id, 0, replace(t, '/src/x', '') || '/main.ets' FROM i WHERE starts_with(t, 'lib') UNION ALL SELECT id, 9, 'real/' || substr(t, 5) || '.ets' FROM i WHERE starts_with(t, 'cfg/'))",
        body='SELECT i.id, t AS "from", b.path FROM i LEFT JOIN (SELECT id, min_by(path, (rank, path)) AS path FROM c WHERE path IN (SELECT path FROM f) GROUP BY id) b USING (id)',
    ),
)
def j11(spark, sf):
    i = X.x_imports(spark, sf)
    n = lambda c: c.cast("string")
    k, o = F.col("ord") % 6, F.col("ord")
    text = (
        F.when(k == 0, F.concat(F.lit("./m"), n(o % 9)))
        .when(k == 1, F.concat(F.lit("../p"), n(F.col("file") % 5), F.lit("/m"), n(o)))
        .when(k == 2, F.concat(F.lit("@ohos."), "name"))
        .when(k == 3, F.concat(F.lit("lib"), n(F.col("file") % 4), F.lit("/src/x")))
        .when(k == 4, F.concat(F.lit("cfg/"), "name"))
        .otherwise(F.concat(F.lit("@kit."), "name"))
    )
    rows = i.select((F.col("file") * 100 + o).alias("id"), F.concat(F.lit("p"), n(F.col("file") % 10)).alias("folder"), text.alias("from"))
    files = [
        i.select(F.concat(F.lit("p"), n(F.col("file") % 10), F.lit("/m"), n(o), F.when(o % 2 == 0, ".ets").otherwise("/index.ets")).alias("path")),
        i.select(F.concat(F.lit("api/@ohos."), "name", F.lit(".d.ts"))),
        i.select(F.concat(F.lit("real/"), "name", F.lit(".ets"))),
        i.where("file % 4 < 3").select(F.concat(F.lit("lib"), n(F.col("file") % 4), F.lit("/main.ets"))),
    ]
    known = files[0].union(files[1]).union(files[2]).union(files[3]).distinct()
    packages = i.select(F.concat(F.lit("lib"), n(F.col("file") % 4)).alias("name"), F.lit("main.ets").alias("main")).distinct()
    mapping = i.limit(1).select(F.lit("cfg/").alias("prefix"), F.lit("real/").alias("to"))
    return J.resolve_module_paths(rows, known, packages, mapping).select("id", "from", "path")


@query("j12_keep_supported", sql("x_findings", "x_vectors", body="SELECT event_id, rule FROM (SELECT event_id, CAST(file % 13 AS INTEGER) AS rule FROM x_findings) WHERE rule IN (SELECT rule FROM x_vectors)"))
def j12(spark, sf):
    f = X.x_findings(spark, sf).select("event_id", (F.col("file") % 13).cast("int").alias("rule"))
    return J.keep_supported(f, X.x_vectors(spark, sf).select("rule"))


@query("j13_match_methods", sql("x_methods", body="SELECT class, name, abstract, CASE WHEN class = 'c0' THEN 'sink' ELSE 'source' END AS role FROM x_methods WHERE class IN ('c0', 'c3', 'r1') AND name IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 4)"))
def j13(spark, sf):
    names = X.table(spark, sf, "customer").where("c_custkey < 4").select(F.col("c_mktsegment").alias("name")).distinct()
    spec = names.select(F.explode(F.array(F.lit("_"), F.lit("c3"), F.lit("r1"))).alias("class"), "name").withColumn("role", F.when(F.col("class") == "_", "sink").otherwise("source"))
    return J.match_methods(spec, X.x_methods(spark, sf), default="c0").select("class", "name", "abstract", "role")


SIGNED = """me AS (SELECT 'm' || CAST(c_custkey AS VARCHAR) AS method, 'f' || CAST(c_nationkey AS VARCHAR) AS file, CASE WHEN c_custkey % 3 > 0 THEN 'ns' || CAST(c_custkey % 3 AS VARCHAR) END AS namespace, CASE WHEN c_custkey % 4 = 0 THEN '_default' ELSE 'c' || CAST(c_custkey % 4 AS VARCHAR) END AS class, c_mktsegment AS name, ['x:number', 'y:string', 'z:any'][1:c_custkey % 4] AS params FROM customer),
    sp AS (SELECT file, coalesce(namespace, '_') AS namespace, CASE WHEN class = '_default' THEN '_' ELSE class END AS class, name, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN params ELSE ['other:any'] END AS params, CASE WHEN c_acctbal < 0 THEN 'source' ELSE 'sink' END AS role, 'm' || CAST(c_custkey AS VARCHAR) AS asked FROM me JOIN customer ON method = 'm' || CAST(c_custkey AS VARCHAR)),
    hit AS (SELECT s.*, m.method, m.params AS has FROM sp s JOIN me m ON m.file = s.file AND m.namespace IS NOT DISTINCT FROM CASE WHEN s.namespace <> '_' THEN s.namespace END AND m.class = CASE WHEN s.class = '_' THEN '_default' ELSE s.class END AND m.name = s.name AND (s.params IS NULL OR s.params = m.params))"""


@query("j13_match_signatures", f"WITH {SIGNED} SELECT role, asked, (SELECT h.method FROM hit h WHERE h.asked = x.asked AND h.role = x.role ORDER BY h.has, h.method LIMIT 1) AS method FROM (SELECT DISTINCT role, asked FROM hit) x")
def j13_signatures(spark, sf):
    c = X.table(spark, sf, "customer")
    k = F.col("c_custkey")
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    space, cls = F.when(k % 3 > 0, tag("ns", k % 3)), tag("c", k % 4)
    params = F.slice(F.array(*map(F.lit, ("x:number", "y:string", "z:any"))), F.lit(1), (k % 4).cast("int"))
    methods = c.select(tag("m", k).alias("method"), tag("f", F.col("c_nationkey")).alias("file"), space.alias("namespace"), F.when(k % 4 == 0, "_default").otherwise(cls).alias("class"), F.col("c_mktsegment").alias("name"), params.alias("params"))
    wanted = F.when(k % 3 == 1, params).when(k % 3 == 2, F.array(F.lit("other:any")))
    spec = c.select(tag("f", F.col("c_nationkey")).alias("file"), F.coalesce(space, F.lit("_")).alias("namespace"), F.when(k % 4 == 0, "_").otherwise(cls).alias("class"), F.col("c_mktsegment").alias("name"), wanted.alias("params"), F.when(F.col("c_acctbal") < 0, "source").otherwise("sink").alias("role"), tag("m", k).alias("asked"))
    return J.match_signatures(spec, methods).select("role", "asked", "method")


def _visible(spark, sf, names):
    r, n = X.table(spark, sf, "region"), X.table(spark, sf, "nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    scopes = r.select(tag("r", "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent")).union(n.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    imports = n.select(tag("n", "n_nationkey").alias("scope"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("source"))
    return J.visible_names(scopes, names, imports)


VISIBLE = """sc AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation),
    im AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS scope, 'n' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS source FROM nation),
    di AS (SELECT scope, name FROM nm UNION SELECT sc.parent, nm.name FROM nm JOIN sc USING (scope) WHERE exported AND parent IS NOT NULL UNION SELECT im.scope, nm.name FROM im JOIN nm ON nm.scope = im.source WHERE exported)"""
VISIBLE_BODY = "SELECT scope, name FROM di UNION SELECT sc.scope, di.name FROM sc JOIN di ON di.scope = sc.parent"


@query("j14_visible_classes", f"WITH nm AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS name, 'n' || CAST(c_nationkey AS VARCHAR) AS scope, c_custkey % 2 = 0 AS exported FROM customer), {VISIBLE} {VISIBLE_BODY}")
def j14(spark, sf):
    c = X.table(spark, sf, "customer")
    return _visible(spark, sf, c.select(F.concat(F.lit("c"), text_of("c_custkey")).alias("name"), F.concat(F.lit("n"), text_of("c_nationkey")).alias("scope"), (F.col("c_custkey") % 2 == 0).alias("exported")))


@query("j15_visible_globals", f"WITH nm AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'r' || CAST(s_nationkey % 5 AS VARCHAR) ELSE 'n' || CAST(s_nationkey AS VARCHAR) END AS scope, s_suppkey % 3 = 0 AS exported FROM supplier), {VISIBLE} {VISIBLE_BODY}")
def j15(spark, sf):
    s = X.table(spark, sf, "supplier")
    scope = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string"))).otherwise(F.concat(F.lit("n"), text_of("s_nationkey")))
    return _visible(spark, sf, s.select(F.concat(F.lit("s"), text_of("s_suppkey")).alias("name"), scope.alias("scope"), (F.col("s_suppkey") % 3 == 0).alias("exported")))


# context

ENCLOSED = BLOCK + ', en AS (SELECT f.path, f.line, f.rule, coalesce(min_by(b.head, b.head), f.line) AS start, coalesce(min_by(b.stop, b.head), f.line) AS stop FROM x_code_findings f LEFT JOIN blk b ON b.path = f.path AND f.line BETWEEN b.head AND b.stop GROUP BY f.path, f.line, f.rule)'
RELATED = r"""nm AS (SELECT path, line_no, unnest(CASE WHEN len(d) > 0 THEN d ELSE u END) AS name FROM (SELECT *, list_concat(regexp_extract_all(text, '@\w+\s+(\w+)', 1), regexp_extract_all(text, 'let\s+(\w+)\s*=', 1)) AS d, regexp_extract_all(text, 'this\.(\w+)', 1) AS u FROM x_code)),
    re AS (SELECT DISTINCT e.path, e.line, c.line_no, CASE WHEN regexp_matches(c.text, '(@\w+.*' || name || '|let.*' || name || '.*=).*;') THEN 'definition' ELSE 'usage' END AS role FROM en e JOIN nm ON nm.path = e.path AND nm.line_no = e.line JOIN x_code c ON c.path = e.path AND NOT c.line_no BETWEEN e.start AND e.stop
    WHERE regexp_matches(c.text, '(@\w+.*' || name || '|let.*' || name || '.*=).*;') OR contains(c.text, 'this.' || name))"""


@query("c1_enclosing_block", sql("x_code_findings", "x_code", more=ENCLOSED, body='SELECT path, line, rule, start, stop AS "end" FROM en'))
def c1(spark, sf):
    return C.enclosing_block(X.x_code_findings(spark, sf), X.x_code(spark, sf)).select("path", "line", "rule", "start", "end")


@query("c2_related_lines", sql("x_code_findings", "x_code", more=f"{ENCLOSED}, {RELATED}", body="SELECT path, line, line_no, role FROM re"))
def c2(spark, sf):
    lines = X.x_code(spark, sf)
    return C.related_lines(C.enclosing_block(X.x_code_findings(spark, sf), lines), lines)


@query("c3_outermost_only", sql("x_code", more=BLOCK, body='SELECT path, head, stop AS "end" FROM (SELECT *, max(stop) OVER (PARTITION BY path ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM blk) WHERE past IS NULL OR head > past'))
def c3(spark, sf):
    return C.outermost_only(V.block_end(X.x_code(spark, sf), F.col("text").rlike(HEAD_PATTERN)))


@query(
    "c4_indent_blocks",
    sql(
        "x_code",
        more="l AS (SELECT path, line_no, repeat('  ', line_no % 4) || trim(text, ' ') AS text, 2 * (line_no % 4) AS ind, max(line_no) OVER (PARTITION BY path) AS last FROM x_code)",
        body="""SELECT h.path, h.line_no AS head, coalesce(min(s.line_no) - 1, h.last) AS "end" FROM l h LEFT JOIN l s ON s.path = h.path AND s.line_no > h.line_no AND s.ind <= h.ind AND trim(s.text, ' ') <> '' WHERE contains(h.text, '{') GROUP BY h.path, h.line_no, h.last""",
    ),
)
def c4(spark, sf):
    lines = X.x_code(spark, sf)
    lines = lines.withColumn("text", F.concat(F.repeat(F.lit("  "), F.col("line_no") % 4), F.trim("text")))
    return C.indent_blocks(lines, F.contains("text", F.lit("{")))


#: the lines of each finding's context
CHOSEN = f"{ENCLOSED}, {RELATED}, ch AS (SELECT DISTINCT path, line, rule, unnest(range(start, stop + 1)) AS line_no FROM en JOIN x_rule_meta USING (rule) UNION SELECT e.path, e.line, e.rule, re.line_no FROM en e JOIN x_rule_meta m ON m.rule = e.rule AND needs_context JOIN re ON re.path = e.path AND re.line = e.line)"


@query(
    "c5_finding_context",
    sql(
        "x_code_findings",
        "x_code",
        "x_rule_meta",
        more=CHOSEN,
        body="SELECT ch.path, line, rule, sha256(string_agg(text, chr(10) ORDER BY ch.line_no)) AS digest FROM ch JOIN x_code c ON c.path = ch.path AND c.line_no = ch.line_no GROUP BY ALL",
    ),
)
def c5(spark, sf):
    out = C.finding_context(X.x_code_findings(spark, sf), X.x_code(spark, sf), X.x_rule_meta(spark, sf))
    return out.select("path", "line", "rule", F.sha2("context", 256).alias("digest"))


GROUPED = ISLANDS.replace('ORDER BY start, "end"', 'ORDER BY start, "end", id')


@query("c6_group_findings", sql("x_ranges", more=GROUPED, body="SELECT path, id, min(id) OVER (PARTITION BY path, island) AS group_id FROM i"))
def c6(spark, sf):
    return C.group_findings(X.x_ranges(spark, sf))


@query(
    "c6_group_multi_range",
    sql(
        "x_ranges",
        recursive=True,
        more=f"r2 AS (SELECT path, id // 2 AS f, start, \"end\" FROM x_ranges), ed AS (SELECT DISTINCT a.f AS s, b.f AS d FROM r2 a JOIN r2 b ON a.path = b.path AND a.f <> b.f AND {MEET}), w AS (SELECT DISTINCT f AS s, f AS d FROM r2 UNION SELECT w.s, ed.d FROM w JOIN ed ON ed.s = w.d)",
        body="SELECT s AS id, min(d) AS group_id FROM w GROUP BY s",
    ),
)
def c6_multi(spark, sf):
    r = X.x_ranges(spark, sf).withColumn("id", F.floor(F.col("id") / 2))
    return C.group_multi_range(r)


SNIPPETS = """fr AS (SELECT path, line - 1 AS start, line + 1 AS "end" FROM x_code_findings), fo AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY path ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM fr), fi AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM fo),
    me AS (SELECT path, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM fi GROUP BY path, island), sn AS (SELECT me.path, start, "end", rtrim(string_agg(text, chr(10) ORDER BY line_no), ' ') AS snippet FROM me JOIN x_code c ON c.path = me.path AND c.line_no BETWEEN start AND "end" GROUP BY ALL)"""


def snippets(spark, sf):
    f = X.x_code_findings(spark, sf).select("path", (F.col("line") - 1).cast("long").alias("start"), (F.col("line") + 1).cast("long").alias("end"))
    return C.group_snippets(f, X.x_code(spark, sf))


@query("c7_group_snippets", sql("x_code_findings", "x_code", more=SNIPPETS, body='SELECT path, start, "end", snippet FROM sn'))
def c7(spark, sf):
    return snippets(spark, sf)


@query("c8_masked_context", sql("x_code_findings", "x_code", more=SNIPPETS, body="SELECT path, string_agg(snippet, chr(10) || '// ...' || chr(10) ORDER BY start) AS context FROM sn GROUP BY path"))
def c8(spark, sf):
    return C.masked_context(snippets(spark, sf))


SHOWN = TOP + ", sh AS (SELECT CAST(qid AS VARCHAR) AS rule, string_agg('Example ' || CAST(place AS VARCHAR) || ':' || chr(10) || 'p' || CAST(id AS VARCHAR) || chr(10) || 'Because: n' || chr(10) || 'Fixed:' || chr(10) || 'f' || CAST(id AS VARCHAR), chr(10) || chr(10) ORDER BY place) AS shown FROM r WHERE place <= 2 GROUP BY qid), gr AS (SELECT path AS group_id, CAST(path % 40 * 10 AS VARCHAR) AS rule, 'Findings:' || chr(10) || 'f' || CAST(path AS VARCHAR) || chr(10) || 'Code:' || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS head FROM x_code GROUP BY path)"


@query("c9_assemble_prompt", sql("x_queries", "x_vectors", "x_code", more=SHOWN, body="SELECT group_id, concat_ws(chr(10) || chr(10), shown, head) AS prompt FROM gr LEFT JOIN sh USING (rule)"))
def c9(spark, sf):
    top = R.top_k_examples(X.x_queries(spark, sf), X.x_vectors(spark, sf), 2)
    examples = top.select(text_of("qid").alias("rule"), "place", F.concat(F.lit("p"), text_of("id")).alias("problem"), F.concat(F.lit("f"), text_of("id")).alias("fix"), F.lit("n").alias("note"))
    groups = code_files(spark, sf).select(F.col("path").alias("group_id"), (F.col("path") % 40 * 10).cast("string").alias("rule"), F.concat(F.lit("f"), text_of("path")).alias("findings"), F.col("content").alias("code"))
    return C.assemble_prompt(groups, examples)


@query("c10_assemble_rule_catalogue", sql("x_docs", more="ru AS (SELECT source AS rule, 'about ' || CAST(count(*) AS VARCHAR) AS d, min(doc_id) AS b, max(doc_id) FILTER (doc_id % 2 = 0) AS g FROM x_docs GROUP BY source)", body="SELECT string_agg(rule || ': ' || d || chr(10) || 'Bad: b' || CAST(b AS VARCHAR) || coalesce(chr(10) || 'Good: g' || CAST(g AS VARCHAR), ''), chr(10) || chr(10) ORDER BY rule) AS catalogue FROM ru"))
def c10(spark, sf):
    r = X.x_docs(spark, sf).groupBy(F.col("source").alias("rule")).agg(F.concat(F.lit("about "), F.count(F.lit(1)).cast("string")).alias("description"), F.concat(F.lit("b"), F.min("doc_id").cast("string")).alias("bad_example"), F.concat(F.lit("g"), F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).cast("string")).alias("good_example"))
    return C.assemble_rule_catalogue(r)


@query("c11_assemble_patch_request", sql("x_pairs", body="SELECT conv_id AS path, string_agg('Segment ' || CAST(turn AS VARCHAR) || ':' || chr(10) || problem || chr(10) || 'Diff:' || chr(10) || repair, chr(10) ORDER BY turn) AS request FROM x_pairs GROUP BY conv_id"))
def c11(spark, sf):
    p = X.x_pairs(spark, sf)
    return C.assemble_patch_request(p.select(F.col("conv_id").alias("path"), F.col("turn").alias("seg"), F.col("problem").alias("segment"), F.col("repair").alias("diff")))


# repair


def responder():
    def reply(prompt: str) -> str:
        if len(prompt) % 11 == 0:
            raise TimeoutError("no answer")
        return "```ets\n" + prompt.partition("\n")[2] + "\n```"

    return reply


ASKED = "length(prompt) % 11 = 0"  # what responder() fails on

@query(
    "r1_run_round",
    sql(
        "x_code_findings",
        "x_code",
        "x_rule_meta",
        more=f"""{CHOSEN}, ctx AS (SELECT ch.path, line, rule, string_agg(text, chr(10) ORDER BY ch.line_no) AS context FROM ch JOIN x_code c ON c.path = ch.path AND c.line_no = ch.line_no GROUP BY ALL),
        asked AS (SELECT path, line, rule, context, 'Rule ' || rule || chr(10) || context AS prompt FROM ctx),
        answered AS (SELECT path, line, rule, NOT {ASKED} AS replied, CASE WHEN {ASKED} THEN context ELSE array_to_string(list_transform(list_filter(string_split(context || chr(10), chr(10)), lambda x: NOT starts_with(x, '-')), lambda x: CASE WHEN starts_with(x, '+') THEN x[2:] ELSE x END), chr(10)) END AS code FROM asked)""",
        body="SELECT path, line, rule, code, replied AND length(replace(code, '{', '')) = length(replace(code, '}', '')) AS success FROM answered",
    ),
)
def r1(spark, sf):
    return Rp.run_round(X.x_code_findings(spark, sf), X.x_code(spark, sf), X.x_rule_meta(spark, sf), responder)


def rows_for_columns():
    return lambda prompt: "```ets\n" + prompt.split("\nCode:\n")[-1].replace("Column", "Row") + "\n```"


def sizes_and_braces():
    return lambda texts: [[float(len(t)), float(t.count("{")) + 1.0] for t in texts]


@query("r1_whole_round")
def r1_whole(spark, sf):
    """All code files through a round that puts rows for columns in the lines asked about."""
    lines = X.x_code(spark, sf)
    files = lines.groupBy(F.col("path").cast("string").alias("path")).agg(ordered_text("line_no", "text").alias("content"))
    findings = X.x_code_findings(spark, sf).withColumn("path", F.col("path").cast("string"))
    s = X.table(spark, sf, "supplier")
    rule = F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string"))
    examples = s.select(F.col("s_suppkey").cast("long").alias("id"), rule.alias("rule"), F.col("s_name").alias("problem"), F.lit("names are short").alias("note"), F.lower("s_name").alias("fix"))
    vectors = s.select(F.col("s_suppkey").cast("long").alias("id"), rule.alias("rule"), F.array(F.col("s_nationkey").cast("double"), F.lit(1.0)).alias("vec"))
    return Rd.run_files(files, findings, X.x_rule_meta(spark, sf), examples, vectors, rows_for_columns, sizes_and_braces)


@query(
    "u1_answer",
    sql(
        "x_replies",
        more="asked AS (SELECT key, text AS prompt FROM x_replies)",
        body=f"SELECT key, prompt, CASE WHEN NOT {ASKED} THEN '```ets' || chr(10) || CASE WHEN contains(prompt, chr(10)) THEN substr(prompt, instr(prompt, chr(10)) + 1) ELSE '' END || chr(10) || '```' END AS reply, CASE WHEN {ASKED} THEN 'TimeoutError: no answer' END AS error FROM asked",
    ),
)
def u1(spark, sf):
    return Rp.answer(X.x_replies(spark, sf).select("key", F.col("text").alias("prompt")), responder)


def originals(spark, sf):
    return X.x_verdicts(spark, sf).groupBy("key").agg(F.concat(F.lit("o"), F.max("attempt").cast("string")).alias("text"))


@query("r2_retry_until", sql("x_verdicts", body="SELECT key, coalesce(min_by(text, attempt) FILTER (success AND attempt <= 2), 'o' || CAST(max(attempt) AS VARCHAR)) AS text, coalesce(bool_or(success AND attempt <= 2), false) AS fixed FROM x_verdicts GROUP BY key"))
def r2(spark, sf):
    return Rp.retry_until(X.x_verdicts(spark, sf), originals(spark, sf), 2)


@query("r3_gate", sql("x_verdicts", body="SELECT key, CASE WHEN bool_or(success) FILTER (attempt = 1) THEN min(text) FILTER (attempt = 1) ELSE 'o' || CAST(max(attempt) AS VARCHAR) END AS text FROM x_verdicts GROUP BY key"))
def r3(spark, sf):
    v = X.x_verdicts(spark, sf).where("attempt = 1")
    return Rp.gate(originals(spark, sf), v.select("key", "text"), v.select("key", "success"))


@query("r4_next_round", sql("x_docs", body="SELECT 1 AS round, path, CASE WHEN doc_id % 3 = 0 THEN 'fixed' ELSE content END AS content FROM x_docs WHERE doc_id % 2 = 0"))
def r4(spark, sf):
    d = X.x_docs(spark, sf).withColumn("round", (F.col("doc_id") % 2).cast("int"))
    return Rp.next_round(d, d.where("doc_id % 3 = 0").select("path", F.lit("fixed").alias("content")), 0)


# sources and sinks


@query("s1_scan_sources", sql("x_docs", body="SELECT 'txt' AS ext, source, CAST(sum(length(coalesce(content, '')) + 1) AS BIGINT) AS n_chars FROM x_docs GROUP BY source"))
def s1(spark, sf):
    """Whole texts, written as files in a folder for each source and read again."""
    root = new_path(spark, "tree")
    X.x_docs(spark, sf).select("source", F.coalesce("content", F.lit("")).alias("value")).write.partitionBy("source").text(root)
    files = io.scan_sources(spark, root, ["txt"], ["_SUCCESS"])
    return files.groupBy("ext", F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum(F.length("content")).alias("n_chars"))


@query("s2_read_findings", sql("x_findings", body="SELECT round, path, line, rule, detail FROM x_findings"))
def s2(spark, sf):
    """The reports of all six rounds, written and read again."""
    found, reports = X.x_findings(spark, sf), []
    for k in range(6):
        path = new_path(spark, "reports")
        io.write_report(found.where(F.col("round") == k), path, "Report of a round")
        reports.append(io.read_findings(spark, path, k))
    return reduce(DataFrame.union, reports)


@query("s3_jsonl", sql("x_docs", body="SELECT path, doc_id, source, content FROM x_docs"))
def s3(spark, sf):
    d, path = X.x_docs(spark, sf), new_path(spark, "jsonl")
    io.write_jsonl(d, path)
    return io.read_jsonl(spark, path, d.schema)


def exemplars(spark, sf):
    p = X.x_pairs(spark, sf)
    rule = F.concat(F.lit("rule"), (F.col("conv_id") % 5).cast("string"))
    return p.select(F.col("key").alias("id"), rule.alias("rule"), F.lit("d").alias("description"), F.col("problem").alias("problem_code"), F.lit("e").alias("problem_explain"), F.col("repair").alias("problem_fix"), F.when(F.col("turn") % 4 == 0, " ").otherwise("g").alias("gpt_diff"), F.lit(None).cast("string").alias("difflib"), (F.col("conv_id") * 100 + F.col("turn")).alias("index"))


@query("s4_read_exemplars", sql("x_pairs", body="SELECT key AS id, 'rule' || CAST(conv_id % 5 AS VARCHAR) AS rule, 'd' AS description, problem AS problem_code, 'e' AS problem_explain, repair AS problem_fix, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'g' END AS gpt_diff, CAST(NULL AS VARCHAR) AS difflib FROM x_pairs"))
def s4(spark, sf):
    path = new_path(spark, "exemplars")
    exemplars(spark, sf).drop("index").write.csv(path, header=True, escape='"', quoteAll=True)
    return io.read_exemplars(spark, path)


RECORDS_A_FILE = 1_000


@query("s5_read_rule_meta", sql("x_docs", body="SELECT '@performance/' || CAST(doc_id AS VARCHAR) AS rule, 'here' AS error_location, source AS fix_location, doc_id % 2 = 0 AS needs_context, CASE WHEN doc_id % 3 <> 0 THEN content END AS bad_code FROM x_docs"))
def s5(spark, sf):
    d, path = X.x_docs(spark, sf), new_path(spark, "rules")
    record = F.struct(F.concat(F.lit("@performance/"), text_of("doc_id")).alias("rule"), F.lit("here").alias("errorLocation"), F.col("source").alias("fixLocation"), (F.col("doc_id") % 2 == 0).alias("needsMoreContext"))
    # each file is one array, read in one task: a source takes as many as keep them small
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-d.count() // RECORDS_A_FILE)))).alias("part")
    d.groupBy("source", part).agg(F.to_json(F.collect_list(record)).alias("value")).write.partitionBy("source", "part").text(path)
    bad = d.where("doc_id % 3 <> 0").select(text_of("doc_id").alias("stem"), "content")
    return io.read_rule_meta(spark, path, bad)


def facts(spark, sf):
    s, e = X.x_stmts(spark, sf), X.x_cfg(spark, sf)
    succ = e.groupBy("method", F.col("src").alias("block")).agg(F.array_sort(F.collect_list("dst")).alias("successors"))
    stmt = F.array(F.struct(F.lit("assign").alias("kind"), F.col("def"), F.array("use").alias("uses"), F.lit(None).cast("string").alias("callee"), F.array().cast("array<string>").alias("args")))
    rows = s.join(succ, ["method", "block"], "left").withColumn("b", F.struct(F.col("block").alias("id"), F.coalesce("successors", F.array().cast("array<int>")).alias("successors"), stmt.alias("stmts")))
    m = rows.groupBy("method").agg(F.array_sort(F.collect_list(F.struct(F.col("b.id").alias("id"), F.col("b.successors").alias("successors"), F.col("b.stmts").alias("stmts")))).alias("blocks"))
    m = m.select(F.floor(F.col("method") / 8).alias("file"), F.struct(F.concat(F.lit("m"), text_of("method")).alias("name"), F.lit(4).alias("modifiers"), "blocks").alias("m"))
    return m.groupBy("file").agg(F.array(F.struct(F.lit("C").alias("name"), F.lit("B").alias("superclass"), F.lit('{"tag": "class"}').alias("type"), F.array_sort(F.collect_list("m")).alias("methods"))).alias("classes")).withColumn("file", text_of("file"))


@query("s6_read_program_facts", sql("x_cfg", body="SELECT CAST(method // 8 AS VARCHAR) || '.C.m' || CAST(method AS VARCHAR) AS method, src, dst FROM x_cfg"))
def s6(spark, sf):
    path = new_path(spark, "facts")
    io.write_jsonl(facts(spark, sf), path)
    return io.read_program_facts(spark, path)["cfg_edges"]


@query("s7_write_round", sql("x_docs", body="SELECT CAST(doc_id % 3 AS INTEGER) AS round, source AS project, path, CASE WHEN doc_id % 3 = 1 THEN 'again' ELSE content END AS content FROM x_docs"))
def s7(spark, sf):
    rows = X.x_docs(spark, sf).select((F.col("doc_id") % 3).cast("int").alias("round"), F.col("source").alias("project"), "path", "content")
    path = new_path(spark, "rounds")
    io.write_round(rows, path)
    io.write_round(rows.where("round = 1").withColumn("content", F.lit("again")), path)
    return spark.read.schema(rows.schema).parquet(path).select("round", "project", "path", "content")


PAIR_KEY = "'rule' || CAST(conv_id % 5 AS VARCHAR) || '_' || CAST(conv_id * 100 + turn AS VARCHAR)"


@query("s8_export_pairs", sql("x_pairs", body=f"SELECT {PAIR_KEY} AS key, problem AS text, 'problem' AS kind FROM x_pairs UNION ALL SELECT {PAIR_KEY}, repair, 'repair' FROM x_pairs"))
def s8(spark, sf):
    p, r = io.export_pairs(exemplars(spark, sf))
    return p.withColumn("kind", F.lit("problem")).union(r.withColumn("kind", F.lit("repair")))


@query("s9_import_pairs", sql("x_pairs", body=f"SELECT {PAIR_KEY} AS key, problem || '!' AS problem_code, repair AS problem_fix FROM x_pairs WHERE conv_id % 2 = 0"))
def s9(spark, sf):
    e = exemplars(spark, sf)
    p, r = io.export_pairs(e)
    return io.import_pairs(e, p.withColumn("text", F.concat("text", F.lit("!"))), r.join(io.export_pairs(e.where("(index - index % 100) / 100 % 2 = 0"))[0].select("key"), "key", "left_semi")).select("key", "problem_code", "problem_fix")


@query("s10_upsert_vectors", sql("x_vectors", body="SELECT sha256('v|' || CAST(id % 200 AS VARCHAR)) AS id, max(id) AS seq, max_by(rule, id) AS rule, CASE WHEN max(id) % 2 = 0 THEN 2 ELSE 1 END AS n_meta FROM x_vectors WHERE id % 7 <> 0 GROUP BY id % 200"))
def s10(spark, sf):
    v = X.x_vectors(spark, sf)
    meta = F.create_map(F.lit("rule"), text_of("rule"), F.lit("diff"), F.when(F.col("id") % 2 == 0, "x"))
    rows = v.select(io.vector_id(F.lit("v"), (F.col("id") % 200).cast("string")).alias("id"), F.col("id").alias("seq"), "rule", F.when(F.col("id") % 7 != 0, F.col("vec")).alias("embedding"), meta.alias("metadata"))
    return io.upsert_vectors(rows.where("seq < 250"), rows.where("seq >= 250")).select("id", "seq", "rule", F.size("metadata").alias("n_meta"))


@query(
    "s11_export_dot",
    sql(
        "x_nodes",
        "x_edges_full",
        more="""li AS (SELECT id % 20 AS graph, 0 AS k, id AS a, CAST(0 AS BIGINT) AS b, '  "' || CAST(id AS VARCHAR) || '" [label="' || name || '"];' AS t FROM x_nodes UNION ALL SELECT src % 20, 1, src, dst, '  "' || CAST(src AS VARCHAR) || '" -> "' || CAST(dst AS VARCHAR) || '";' FROM x_edges_full)""",
        body="""SELECT graph, 'digraph "' || CAST(graph AS VARCHAR) || '" {' || chr(10) || string_agg(t, chr(10) ORDER BY k, a, b) || chr(10) || '}' AS text FROM li GROUP BY graph""",
    ),
)
def s11(spark, sf):
    return io.export_dot(X.x_nodes(spark, sf).withColumn("graph", F.col("id") % 20), X.x_edges_full(spark, sf).withColumn("graph", F.col("src") % 20))


@query(
    "s11_export_from_start",
    sql(
        "x_nodes",
        "x_edges_full",
        recursive=True,
        more="""gr AS (SELECT id % 20 AS graph, * FROM x_nodes), ge AS (SELECT src % 20 AS graph, src, dst FROM x_edges_full WHERE dst % 20 = src % 20), se AS (SELECT graph, id FROM gr WHERE id = graph UNION SELECT se.graph, ge.dst FROM se JOIN ge ON ge.graph = se.graph AND ge.src = se.id),
        li AS (SELECT graph, 0 AS k, id AS a, CAST(0 AS BIGINT) AS b, '  "' || CAST(id AS VARCHAR) || '" [label="' || name || '"];' AS t FROM gr JOIN se USING (graph, id) UNION ALL SELECT graph, 1, src, dst, '  "' || CAST(src AS VARCHAR) || '" -> "' || CAST(dst AS VARCHAR) || '";' FROM ge JOIN se USING (graph) WHERE se.id = ge.src)""",
        body="""SELECT graph, 'digraph "' || CAST(graph AS VARCHAR) || '" {' || chr(10) || string_agg(t, chr(10) ORDER BY k, a, b) || chr(10) || '}' AS text FROM li GROUP BY graph""",
    ),
)
def s11_start(spark, sf):
    """Of each graph what its first node reaches."""
    nodes, edges = X.x_nodes(spark, sf).withColumn("graph", F.col("id") % 20), X.x_edges_full(spark, sf).withColumn("graph", F.col("src") % 20).where("dst % 20 = graph")
    return io.export_dot(nodes, edges, nodes.where("id = graph").select("graph", "id"))


@query(
    "s12_nest_program",
    sql(
        "x_blocks",
        "x_cfg",
        "x_stmts",
        body="""SELECT b.method, CAST(count(*) AS INTEGER) AS n_blocks, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_succ, string_agg(coalesce(s.t, ''), ';' ORDER BY b.block) AS succ FROM x_blocks b LEFT JOIN (SELECT method, src, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS t FROM x_cfg GROUP BY ALL) s ON s.method = b.method AND s.src = b.block GROUP BY b.method""",
    ),
)
def s12(spark, sf):
    stmts = X.x_stmts(spark, sf).withColumn("idx", F.lit(0))
    out = io.nest_program(X.x_blocks(spark, sf), X.x_cfg(spark, sf), stmts)
    parsed = out.withColumn("b", F.from_json("json", "array<struct<id:int,successors:array<int>,predecessors:array<int>>>"))
    succ = F.array_join(F.transform("b", lambda x: F.array_join(x["successors"].cast("array<string>"), ",")), ";")
    n = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.size(x["successors"]))
    return parsed.select("method", F.size("b").alias("n_blocks"), n.alias("n_succ"), succ.alias("succ"))


# restarts and streams


@query("i1_resume", PENDING)
def i1(spark, sf):
    d, path = X.x_docs(spark, sf), new_path(spark, "processed")
    I.mark(d.where("doc_id % 6 = 0"), path)
    I.mark(d.where("doc_id % 6 = 3"), path)
    return I.resume(d.select("path"), spark.read.schema("path string").parquet(path))


@query("i2_stream_findings", sql("x_findings", body="SELECT rule, count(*) AS n FROM (SELECT DISTINCT path, rule, line FROM x_findings) GROUP BY rule"))
def i2(spark, sf):
    rows = X.x_findings(spark, sf).join(X.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id").select("path", "rule", "line", "ts")
    source, out, checkpoint = (new_path(spark, x) for x in ("arrivals", "counts", "progress"))
    rows.repartition(4).write.parquet(source)
    I.stream_findings(spark, source, rows.schema, out, checkpoint).awaitTermination()
    return I.counts(spark, out)
