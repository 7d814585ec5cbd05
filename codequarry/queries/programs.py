"""Queries of the call-graph, dataflow and points-to operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import calls as K
from codequarry.operators import flow as L
from codequarry.operators import pointers as P
from codequarry.operators import tracking as T
from codequarry.plans import standins as X
from codequarry.plans.fixpoint import dealt, stored
from codequarry.plans.standins import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def kinds(spark, sf):
    k = F.col("site") % 3
    s = X.x_sites(spark, sf).withColumn("kind", F.when(k == 0, "static").when(k == 1, "special").otherwise("dynamic"))
    return s.withColumn("declared", F.when(F.col("kind") == "special", F.col("creates")).otherwise(F.col("declared")))


@query("g13_direct_calls", sql("x_sites", "x_methods", more="k AS (SELECT *, CASE site % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'special' ELSE 'dynamic' END AS kind, CASE WHEN site % 3 = 1 THEN creates ELSE declared END AS d FROM x_sites)", body="SELECT DISTINCT caller AS src, d || '.' || name AS dst, kind FROM k WHERE kind <> 'dynamic' AND (d, name) IN (SELECT (class, name) FROM x_methods)"))
def g13(spark, sf):
    return K.direct_calls(kinds(spark, sf), X.x_methods(spark, sf))[0]


SUBS = "sb AS (SELECT class, class AS sub FROM x_classes UNION SELECT s.class, e.child FROM sb s JOIN x_extends e ON e.parent = s.sub)"


def subs(spark, sf):
    return K.subclasses(X.x_extends(spark, sf), X.x_classes(spark, sf))


@query("g14_subclasses", sql("x_classes", "x_extends", recursive=True, more=SUBS, body="SELECT class, sub FROM sb"))
def g14(spark, sf):
    return subs(spark, sf)


TARGETS = SUBS + ", ta AS (SELECT s.site, s.caller, m.class AS callee FROM x_sites s JOIN sb ON sb.class = 'n' || CAST(s.site % 25 AS VARCHAR) JOIN x_methods m ON m.class = sb.sub AND m.name = s.name AND NOT m.abstract JOIN x_classes c ON c.class = m.class AND NOT c.abstract)"


def sites(spark, sf):
    """All sites; each declares the nation that its region was taken from."""
    return X.x_sites(spark, sf).withColumn("declared", F.concat(F.lit("n"), (F.col("site") % 25).cast("string")))


def dispatched(spark, sf):
    return K.dispatch(subs(spark, sf), X.x_classes(spark, sf), X.x_methods(spark, sf))


def entries(spark, sf):
    """Classes of customers with a balance below 0: a fixed share, whatever the table's size."""
    c = X.table(spark, sf, "customer").where("c_acctbal < 0")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("class"))


@query("g15_calls_by_hierarchy", sql("x_classes", "x_extends", "x_sites", "x_methods", recursive=True, more=TARGETS + ", re AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS class FROM customer WHERE c_acctbal < 0 UNION SELECT callee FROM re JOIN ta ON ta.caller = re.class)", body="SELECT site, caller, callee FROM ta WHERE caller IN (SELECT class FROM re)"))
def g15(spark, sf):
    return K.reached_calls(sites(spark, sf), dispatched(spark, sf), entries(spark, sf))


def own_class_only(sites, table):
    """A resolver for languages without overriding: a call enters the first class, by name, that has the method."""
    first = table.groupBy("class", "name").agg(F.min("callee").alias("callee"))
    return sites.withColumnRenamed("declared", "class").join(first, ["class", "name"])


@query("u5_call_resolver", sql("x_classes", "x_extends", "x_sites", "x_methods", recursive=True, more=TARGETS, body="SELECT site, min(caller) AS caller, min(callee) AS callee FROM ta GROUP BY site"))
def u5(spark, sf):
    sites = X.x_sites(spark, sf).withColumn("declared", F.concat(F.lit("n"), (F.col("site") % 25).cast("string")))
    return K.targets(sites, subs(spark, sf), X.x_classes(spark, sf), X.x_methods(spark, sf), resolve=own_class_only)


# methods and classes are reached together: keyed recursion, since each step reads all so far
INSTANTIATED = TARGETS + """, cr AS (SELECT DISTINCT caller, creates AS class FROM x_sites), st(item, kind, k) USING KEY (item, kind) AS (
    SELECT 'c' || CAST(c_custkey AS VARCHAR), 'method', 0 FROM customer WHERE c_acctbal < 0
    UNION SELECT item, kind, 1 FROM (SELECT cr.class AS item, 'class' AS kind FROM recurring.st s JOIN cr ON cr.caller = s.item WHERE s.kind = 'method'
        UNION SELECT t.callee, 'method' FROM ta t JOIN recurring.st a ON a.kind = 'method' AND a.item = t.caller JOIN recurring.st b ON b.kind = 'class' AND b.item = t.callee) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.st r WHERE r.item = x.item AND r.kind = x.kind))"""


@query("g16_calls_by_instantiation", sql("x_classes", "x_extends", "x_sites", "x_methods", recursive=True, more=INSTANTIATED, body="SELECT site, caller, callee FROM ta WHERE caller IN (SELECT item FROM st WHERE kind = 'method') AND callee IN (SELECT item FROM st WHERE kind = 'class')"))
def g16(spark, sf):
    creates = X.x_sites(spark, sf).select("caller", F.col("creates").alias("class"))
    return K.reached_calls(sites(spark, sf), dispatched(spark, sf), entries(spark, sf), creates)


@query(
    "g17_program_entries",
    sql(
        "x_classes",
        "x_extends",
        "x_methods",
        recursive=True,
        more=SUBS,
        body="""SELECT DISTINCT class, name FROM x_methods m WHERE name IN ('BUILDING', 'MACHINERY') AND class IN (SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 9 = 0)
        OR name IN ('BUILDING', 'MACHINERY') AND class IN (SELECT sub FROM sb WHERE class = 'n3') OR name = 'FURNITURE' AND class IN (SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0)
        OR class IN (SELECT 'c' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')""",
    ),
)
def g17(spark, sf):
    c, o = X.table(spark, sf, "customer"), X.table(spark, sf, "orders")
    name = lambda col: F.concat(F.lit("c"), F.col(col).cast("string")).alias("class")
    handlers = o.where("o_orderstatus = 'P'").select(name("o_custkey")).distinct().join(X.x_methods(spark, sf).select("class", "name"), "class")
    bases = X.x_classes(spark, sf).where("class = 'n3'").select("class")
    return K.program_entries(X.x_methods(spark, sf), c.where("c_custkey % 9 = 0").select(name("c_custkey")), subs(spark, sf), bases, c.where("c_custkey % 5 = 0").select(name("c_custkey")), handlers, F.col("name").isin("BUILDING", "MACHINERY"), F.col("name") == "FURNITURE")


def procedures(spark, sf):
    """Relations over the stand-in methods: method m's second block calls method m + 1."""
    s, e = stored(X.x_stmts(spark, sf)), stored(X.x_cfg(spark, sf))
    node = lambda m, b: (m * 1000 + b).cast("long")
    m, b = F.col("method"), F.col("block")
    rows = s.join(e.select("method", F.col("src").alias("block"), "dst"), ["method", "block"])
    facts = F.array(F.lit("v0"), F.lit("v1"), F.lit("v2"))
    rows = rows.withColumn("fact", F.explode(facts))
    out = F.array_compact(F.array(F.when(F.col("def") != F.col("fact"), F.col("fact")), F.when(F.col("use") == F.col("fact"), F.col("def"))))
    is_call = b == 2
    normal = rows.where(~is_call).select(node(m, b).alias("node"), "fact", node(m, F.col("dst")).alias("to"), F.explode(out).alias("fact_to"))
    past = rows.where(is_call & (F.col("def") != F.col("fact"))).select(node(m, b).alias("node"), "fact", node(m, F.col("dst")).alias("to"), F.col("fact").alias("fact_to"))
    methods = s.select("method").distinct()
    sites = s.where(is_call).join(methods.select((m - 1).alias("method")), "method", "left_semi")
    calls = sites.select(node(m, b).alias("node"), F.col("use").alias("fact"), node(m + 1, F.lit(1)).alias("start"), F.lit("v0").alias("start_fact"))
    last = s.groupBy("method").agg(F.max("block").alias("end"))
    back = sites.join(e.select("method", F.col("src").alias("block"), "dst"), ["method", "block"]).join(last.select((m - 1).alias("method"), "end"), "method")
    returns = back.select(node(m + 1, F.col("end")).alias("node"), F.lit("v1").alias("fact"), node(m, b).alias("call"), node(m, F.col("dst")).alias("to"), F.col("def").alias("fact_to"))
    seeds = methods.where("method % 4 = 0").select(node(m, F.lit(1)).alias("node"), F.lit("v0").alias("fact"))
    return seeds, normal.union(past), calls, returns


PROCEDURES = """ps AS (SELECT * FROM x_stmts), pc AS (SELECT * FROM x_cfg), pf AS (SELECT s.*, c.dst, f.fact FROM ps s JOIN pc c ON c.method = s.method AND c.src = s.block, (VALUES ('v0'), ('v1'), ('v2')) f(fact)),
    no AS (SELECT method * 1000 + block AS node, fact, method * 1000 + dst AS t, fact AS ft FROM pf WHERE def <> fact UNION SELECT method * 1000 + block, fact, method * 1000 + dst, def FROM pf WHERE block <> 2 AND use = fact),
    si AS (SELECT * FROM ps WHERE block = 2 AND method + 1 IN (SELECT method FROM ps)), ca AS (SELECT method * 1000 + 2 AS node, use AS fact, (method + 1) * 1000 + 1 AS start FROM si),
    rt AS (SELECT (si.method + 1) * 1000 + l.last AS node, 'v1' AS fact, si.method * 1000 + 2 AS call, si.method * 1000 + c.dst AS t, si.def AS ft FROM si JOIN pc c ON c.method = si.method AND c.src = 2 JOIN (SELECT method, max(block) AS last FROM ps GROUP BY method) l ON l.method = si.method + 1),
    pe(s, sf, n, f, k) USING KEY (s, sf, n, f) AS (SELECT DISTINCT method * 1000 + 1, 'v0', method * 1000 + 1, 'v0', 0 FROM ps WHERE method % 4 = 0 UNION SELECT s, sf, n, f, 1 FROM (
        SELECT a.s, a.sf, no.t AS n, no.ft AS f FROM recurring.pe a JOIN no ON no.node = a.n AND no.fact = a.f
        UNION SELECT ca.start, 'v0', ca.start, 'v0' FROM recurring.pe a JOIN ca ON ca.node = a.n AND ca.fact = a.f
        UNION SELECT a.s, a.sf, rt.t, rt.ft FROM recurring.pe a JOIN ca ON ca.node = a.n AND ca.fact = a.f JOIN recurring.pe z ON z.s = ca.start AND z.sf = 'v0' JOIN rt ON rt.node = z.n AND rt.fact = z.f AND rt.call = a.n) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.pe r WHERE r.s = x.s AND r.sf = x.sf AND r.n = x.n AND r.f = x.f))"""


@query("g18_dataflow_reach", sql("x_stmts", "x_cfg", recursive=True, more=PROCEDURES, body="SELECT s AS start, sf AS start_fact, n AS node, f AS fact FROM pe"))
def g18(spark, sf):
    return L.dataflow_reach(*procedures(spark, sf))


TAINT = """ta AS (SELECT s.method, s.block AS source, c.dst AS block, s.def AS fact FROM x_stmts s JOIN x_cfg c ON c.method = s.method AND c.src = s.block WHERE s.block % 7 = 0
    UNION SELECT t.method, t.source, c.dst, f.fact FROM ta t JOIN x_stmts s ON s.method = t.method AND s.block = t.block JOIN x_cfg c ON c.method = t.method AND c.src = t.block, LATERAL (SELECT t.fact AS fact WHERE s.def <> t.fact UNION ALL SELECT s.def WHERE s.use = t.fact) f)"""


@query("g19_taint_flows", sql("x_stmts", "x_cfg", recursive=True, more=TAINT, body="SELECT t.method, t.source, t.block AS sink, t.fact FROM ta t JOIN x_stmts s ON s.method = t.method AND s.block = t.block AND s.use = t.fact WHERE t.block % 5 = 0"))
def g19(spark, sf):
    s = stored(X.x_stmts(spark, sf))
    return L.taint_flows(s, X.x_cfg(spark, sf), s.where("block % 7 = 0").select("method", "block"), s.where("block % 5 = 0").select("method", "block"))


@query("u3_flow_rules", sql("x_cfg", recursive=True, more="pe AS (SELECT DISTINCT method * 1000 + 1 AS start, method * 1000 + 1 AS node, 0 AS fact FROM x_cfg WHERE method % 3 = 0 UNION SELECT pe.start, c.method * 1000 + c.dst, (pe.fact + c.src) % 4 FROM pe JOIN x_cfg c ON c.method * 1000 + c.src = pe.node)", body="SELECT start, 0 AS start_fact, node, fact FROM pe"))
def u3(spark, sf):
    """Flow rules given as a function of path edges: each block adds its number to the fact, modulo 4."""
    e = stored(X.x_cfg(spark, sf))
    node = lambda c: (F.col("method") * 1000 + F.col(c)).cast("long")
    after = dealt(e.select(node("src").alias("node"), F.col("src").alias("_add"), node("dst").alias("to")), ["node"])
    seeds = e.where("method % 3 = 0").select((F.col("method") * 1000 + 1).cast("long").alias("node"), F.lit(0).alias("fact")).distinct()
    never = lambda *columns: lambda paths: paths.where("false").select("*", *columns)
    none = F.lit(None).cast("long")
    return L.dataflow_reach(
        seeds,
        lambda paths: after.join(paths).withColumn("fact_to", ((F.col("fact") + F.col("_add")) % 4).cast("int")),
        never(none.alias("callee"), F.lit(0).alias("callee_fact")),
        never(none.alias("call"), none.alias("to"), F.lit(0).alias("fact_to")),
    )


# path edges: start, its fact (source, base, field), node, fact; source -1 is "nothing yet"
TRACKED = """fs AS MATERIALIZED (SELECT * FROM x_flow), mt AS MATERIALIZED (SELECT method, method * 1000 + 1 AS first, max(node) AS last FROM fs GROUP BY method),
    af AS MATERIALIZED (SELECT method * 1000 + src AS node, method * 1000 + dst AS t FROM x_cfg), cl AS MATERIALIZED (SELECT f.node, f.db, f.ub, m.first AS callee, m.last FROM fs f JOIN mt m ON f.calls AND m.method = f.method + 1), ge AS (SELECT node, db AS b, df AS f FROM fs WHERE GEN),
    pe(s, ss, sb, sf, n, c, b, f, k) USING KEY (s, ss, sb, sf, n, c, b, f) AS (SELECT DISTINCT first, CAST(-1 AS BIGINT), '', '', first, CAST(-1 AS BIGINT), '', '', 0 FROM mt WHERE method % 8 = 0 UNION SELECT *, 1 FROM (
        SELECT p.s, p.ss, p.sb, p.sf, af.t AS n, p.c, p.b, p.f FROM recurring.pe p JOIN af ON af.node = p.n JOIN fs ON fs.node = p.n WHERE p.c = -1 OR NOT (fs.db = p.b AND (fs.df = '' OR fs.df = p.f))
        UNION SELECT p.s, p.ss, p.sb, p.sf, af.t, p.c, fs.db, CASE WHEN fs.df <> '' THEN fs.df WHEN fs.uf = '' THEN p.f ELSE '' END FROM recurring.pe p JOIN af ON af.node = p.n JOIN fs ON fs.node = p.n AND fs.ub = p.b AND (fs.uf = '' OR fs.uf = p.f OR THROUGH AND p.f = '') WHERE p.n NOT IN (SELECT node FROM cl)
        UNION SELECT p.s, p.ss, p.sb, p.sf, af.t, ge.node, ge.b, ge.f FROM recurring.pe p JOIN af ON af.node = p.n JOIN ge ON ge.node = p.n WHERE p.c = -1
        UNION SELECT cl.callee, p.c, '', '', cl.callee, p.c, '', '' FROM recurring.pe p JOIN cl ON cl.node = p.n WHERE p.c = -1
        UNION SELECT cl.callee, p.c, 'v0', p.f, cl.callee, p.c, 'v0', p.f FROM recurring.pe p JOIN cl ON cl.node = p.n AND cl.ub = p.b
        UNION SELECT p.s, p.ss, p.sb, p.sf, af.t, z.c, r.b, z.f FROM recurring.pe p JOIN cl ON cl.node = p.n AND (p.c = -1 OR cl.ub = p.b) JOIN recurring.pe z ON z.s = cl.callee AND z.n = cl.last AND z.ss = p.c AND z.sb = CASE WHEN p.c = -1 THEN '' ELSE 'v0' END AND z.sf = p.f JOIN af ON af.node = p.n,
            LATERAL (SELECT cl.db AS b WHERE z.b = 'v1' UNION ALL SELECT cl.ub WHERE z.b = 'v0' AND z.f <> '') r) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.pe r WHERE r.s = x.s AND r.ss = x.ss AND r.sb = x.sb AND r.sf = x.sf AND r.n = x.n AND r.c = x.c AND r.b = x.b AND r.f = x.f))"""


def flow_program(spark, sf):
    tables, rows = X.x_flow(spark, sf)
    return T.Program(**tables), rows


@query("g19_taint_across_methods", sql("x_flow", recursive=True, more=TRACKED.replace("GEN", "q > 45").replace("THROUGH", "true"), body="SELECT DISTINCT p.c AS source, p.n AS sink, p.b AS base, p.f AS field FROM pe p JOIN fs ON fs.node = p.n AND fs.ub = p.b AND fs.q < 5 WHERE p.c <> -1"))
def g19_across(spark, sf):
    program, rows = flow_program(spark, sf)
    sources = rows.where("quantity > 45").select("node", F.col("def_base").alias("base"), F.col("def_field").alias("field"))
    return T.taint_flows(program, sources, rows.where("quantity < 5").select("node", F.col("use_base").alias("base")))


@query("g20_undefined_fields", sql("x_flow", recursive=True, more=TRACKED.replace("GEN", "q > 47 OR q < 2").replace("THROUGH", "false"), body="SELECT DISTINCT p.n AS node, p.b AS base, fs.uf AS field, p.c AS source FROM pe p JOIN fs ON fs.node = p.n AND fs.ub = p.b AND fs.uf <> '' WHERE p.c <> -1 AND p.f = ''"))
def g20_fields(spark, sf):
    program, rows = flow_program(spark, sf)
    missing = rows.where("quantity > 47 or quantity < 2").select("node", F.col("def_base").alias("base"), F.col("def_field").alias("field"))
    return T.undefined_uses(program, missing)


@query("g20_undefined_uses", sql("x_stmts", "x_cfg", recursive=True, more="u AS (SELECT DISTINCT method, 1 AS block, use AS name FROM x_stmts UNION SELECT u.method, c.dst, u.name FROM u JOIN x_stmts s ON s.method = u.method AND s.block = u.block AND s.def <> u.name JOIN x_cfg c ON c.method = u.method AND c.src = u.block)", body="SELECT u.method, u.block, u.name FROM u JOIN x_stmts s ON s.method = u.method AND s.block = u.block AND s.use = u.name"))
def g20(spark, sf):
    return L.undefined_uses(X.x_stmts(spark, sf), X.x_cfg(spark, sf))


# f: the field of a cell, -1 for a plain variable
FIELDS = """pt(v, f, obj, k) USING KEY (v, f, obj) AS (SELECT dst, -1, src, 0 FROM x_pag WHERE kind = 'address' UNION SELECT v, f, obj, 1 FROM (
    SELECT p.dst AS v, -1 AS f, a.obj FROM recurring.pt a JOIN x_pag p ON p.kind = 'copy' AND a.f = -1 AND p.src = a.v
    UNION SELECT p.dst, -1, c.obj FROM recurring.pt a JOIN x_pag p ON p.kind = 'load' AND a.f = -1 AND p.src = a.v JOIN recurring.pt c ON c.v = a.obj AND c.f = p.field
    UNION SELECT a.obj, p.field, w.obj FROM recurring.pt a JOIN x_pag p ON p.kind = 'write' AND a.f = -1 AND p.dst = a.v JOIN recurring.pt w ON w.f = -1 AND w.v = p.src) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.pt r WHERE r.v = x.v AND r.f = x.f AND r.obj = x.obj))"""


@query("g21_points_to", sql("x_pag", recursive=True, more=FIELDS, body="SELECT v AS var, obj FROM pt WHERE f = -1"))
def g21(spark, sf):
    return L.variables(L.points_to(X.x_pag(spark, sf)))


CONTEXTS = """pt AS (SELECT dst AS var, CAST([] AS BIGINT[]) AS ctx, src AS obj FROM x_pag WHERE kind = 'address'
UNION SELECT p.dst, CASE WHEN p.src % 5 = 0 THEN list_prepend(CAST(p.dst AS BIGINT), ctx)[1:2] ELSE ctx END, obj FROM pt JOIN x_pag p ON p.src = pt.var AND p.kind = 'copy')"""


@query("g22_points_to_ctx", sql("x_pag", recursive=True, more=CONTEXTS, body="SELECT var, array_to_string(ctx, ',') AS ctx, obj FROM pt"))
def g22(spark, sf):
    p = X.x_pag(spark, sf).where("kind in ('address', 'copy')")
    calls = p.where("kind = 'copy' and src % 5 = 0").select("src", "dst", F.col("dst").alias("callee"))
    return L.points_to_ctx(p.where("kind = 'address' or src % 5 <> 0"), calls, 2).select("var", F.array_join(F.col("ctx").cast("array<string>"), ",").alias("ctx"), "obj")


# facts of both relations: holds 'h' (variable, context, object, its context), cell 'c', enters 'e' (site, context, callee), runs 'r'
ON_THE_FLY = """mk AS (SELECT method, site AS o, v FROM x_program WHERE p = 5 AND odd = 0), cp AS (SELECT v AS a, w AS b FROM x_program WHERE p = 5 AND odd = 1),
    ld AS (SELECT v AS base, field, w AS b FROM x_program WHERE p = 4), wr AS (SELECT v AS base, field, w AS a FROM x_program WHERE p = 3), di AS (SELECT site AS o, k AS name, least(method - method % 8 + (site + k) % 8, n - 1) AS callee FROM x_program, (VALUES (0), (1)) t(k) WHERE p = 5 AND odd = 0),
    ar AS (SELECT site, CASE WHEN p = 1 THEN v ELSE w END AS value FROM x_program WHERE p <= 2), rs AS (SELECT site, w AS result FROM x_program WHERE p <= 2 AND site % 3 > 0),
    fa(kind, id, ctx, field, obj, made, k) USING KEY (kind, id, ctx, field, obj, made) AS (SELECT DISTINCT 'r', CAST(c_custkey AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), 0 FROM customer WHERE c_acctbal < 0 UNION SELECT *, 1 FROM (
        SELECT 'h' AS kind, mk.v AS id, f.ctx AS ctx, -1 AS field, mk.o AS obj, f.ctx AS made FROM recurring.fa f JOIN mk ON f.kind = 'r' AND mk.method = f.id
        UNION SELECT 'e', x.site, f.ctx, -1, x.callee, CAST([] AS BIGINT[]) FROM recurring.fa f JOIN x_program x ON f.kind = 'r' AND x.p = 1 AND x.method = f.id
        UNION SELECT 'h', cp.b, f.ctx, -1, f.obj, f.made FROM recurring.fa f JOIN cp ON f.kind = 'h' AND cp.a = f.id
        UNION SELECT 'r', f.obj, list_prepend(f.obj, f.ctx)[1:K], -1, -1, CAST([] AS BIGINT[]) FROM recurring.fa f WHERE f.kind = 'e'
        UNION SELECT 'e', x.site, f.ctx, -1, di.callee, CAST([] AS BIGINT[]) FROM recurring.fa f JOIN x_program x ON f.kind = 'h' AND x.p = 2 AND x.v = f.id JOIN di ON di.o = f.obj AND di.name = x.name
        UNION SELECT 'h', di.callee * 4, list_prepend(di.callee, f.ctx)[1:K], -1, f.obj, f.made FROM recurring.fa f JOIN x_program x ON f.kind = 'h' AND x.p = 2 AND x.v = f.id JOIN di ON di.o = f.obj AND di.name = x.name
        UNION SELECT 'h', ld.b, f.ctx, -1, c.obj, c.made FROM recurring.fa f JOIN ld ON f.kind = 'h' AND ld.base = f.id JOIN recurring.fa c ON c.kind = 'c' AND c.id = f.obj AND c.ctx = f.made AND c.field = ld.field
        UNION SELECT 'c', f.obj, f.made, wr.field, s.obj, s.made FROM recurring.fa f JOIN wr ON f.kind = 'h' AND wr.base = f.id JOIN recurring.fa s ON s.kind = 'h' AND s.id = wr.a AND s.ctx = f.ctx
        UNION SELECT 'h', e.obj * 4 + 1, list_prepend(e.obj, e.ctx)[1:K], -1, f.obj, f.made FROM recurring.fa e JOIN ar ON e.kind = 'e' AND ar.site = e.id JOIN recurring.fa f ON f.kind = 'h' AND f.id = ar.value AND f.ctx = e.ctx
        UNION SELECT 'h', rs.result, e.ctx, -1, f.obj, f.made FROM recurring.fa e JOIN rs ON e.kind = 'e' AND rs.site = e.id JOIN recurring.fa f ON f.kind = 'h' AND f.id = e.obj * 4 + 3 AND f.ctx = list_prepend(e.obj, e.ctx)[1:K]) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.fa r WHERE r.kind = x.kind AND r.id = x.id AND r.ctx = x.ctx AND r.field = x.field AND r.obj = x.obj AND r.made = x.made))"""


def context(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("g22_points_to_on_the_fly", sql("x_program", recursive=True, more=ON_THE_FLY.replace("K]", "2]"), body="SELECT CASE kind WHEN 'h' THEN 'variable' ELSE 'site' END AS of, id, array_to_string(ctx, ',') AS ctx, obj AS to, CASE kind WHEN 'h' THEN array_to_string(made, ',') END AS made FROM fa WHERE kind IN ('h', 'e')"))
def g22_on_the_fly(spark, sf):
    """What variables hold and which methods call sites enter, with contexts of two callees."""
    held, edges = P.points_to_on_the_fly(**X.x_program(spark, sf), k=2)
    held = held.select(F.lit("variable").alias("of"), F.col("var").alias("id"), context("ctx"), F.col("obj").alias("to"), context("made"))
    return held.union(edges.select(F.lit("site"), "site", context("ctx"), "callee", F.lit(None).cast("string")))


COPIES = "pt AS (SELECT dst AS var, src AS obj FROM x_pag WHERE kind = 'address' UNION SELECT p.dst, pt.obj FROM pt JOIN x_pag p ON p.src = pt.var AND p.kind = 'copy')"


def copied(spark, sf):
    """Points-to without field edges, for which plain recursion in SQL is enough."""
    return L.variables(L.points_to(X.x_pag(spark, sf).where("kind in ('address', 'copy')")))


@query("g21_points_to_copies", sql("x_pag", recursive=True, more=COPIES, body="SELECT var, obj FROM pt"))
def g21_copies(spark, sf):
    return copied(spark, sf)


@query("g23_may_alias", sql("x_pag", "x_edges_full", recursive=True, more=COPIES, body="SELECT DISTINCT e.src AS a, e.dst AS b FROM x_edges_full e JOIN pt a ON a.var = e.src JOIN pt b ON b.var = e.dst AND b.obj = a.obj"))
def g23(spark, sf):
    pairs = X.x_edges_full(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return L.may_alias(pairs, copied(spark, sf))


@query("g24_related_values", sql("x_edges_half", recursive=True, more="s AS (SELECT src AS a, dst AS b FROM x_edges_half UNION SELECT dst, src FROM x_edges_half), w AS (SELECT a AS root, a AS node FROM s WHERE a IN (SELECT c_custkey FROM customer WHERE c_acctbal < -950) UNION SELECT root, b FROM w JOIN s ON a = node)", body="SELECT root, node FROM w"))
def g24(spark, sf):
    e = X.x_edges_half(spark, sf)
    asked = X.table(spark, sf, "customer").where("c_acctbal < -950").select(F.col("c_custkey").alias("id"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().join(asked, "id", "left_semi")
    return L.related_values(e, ids)


@query("g25_type_mismatches", sql("x_pag", recursive=True, more=COPIES, body="SELECT var, declared, found FROM (SELECT var, c_mktsegment AS declared, array_to_string(list_sort(list(DISTINCT 't' || CAST(s_nationkey % 3 AS VARCHAR))), ',') AS found FROM pt JOIN supplier ON -s_suppkey - 1 = obj JOIN (SELECT c_custkey, 't' || CAST(c_nationkey % 3 AS VARCHAR) AS c_mktsegment FROM customer) ON c_custkey = var GROUP BY ALL) WHERE found <> declared"))
def g25(spark, sf):
    kind = lambda c: F.concat(F.lit("t"), (F.col(c) % 3).cast("string"))
    types = X.table(spark, sf, "supplier").select((-F.col("s_suppkey") - 1).alias("obj"), kind("s_nationkey").alias("type"))
    declared = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("var"), kind("c_nationkey").alias("declared"))
    return L.type_mismatches(declared, copied(spark, sf), types)


STORAGE = "st AS (SELECT CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'link' WHEN 'purchase' THEN 'prop' WHEN 'signup' THEN 'set' ELSE 'get' END AS call, 'k' || CAST(event_id % 97 + CASE WHEN event_type = 'error' THEN 50 ELSE 0 END AS VARCHAR) AS key, 'v' || CAST(event_id % 31 AS VARCHAR) AS value, 'l' || CAST(event_id % 4001 AS VARCHAR) AS local FROM events)"


@query(
    "g26_storage_links",
    f"""WITH {STORAGE} SELECT value AS src, 'key:' || key AS dst FROM st WHERE call = 'create' UNION SELECT local, 'key:' || key FROM st WHERE call = 'link' UNION SELECT 'key:' || key, local FROM st WHERE call IN ('link', 'prop')
    UNION SELECT value, local FROM st WHERE call = 'set' AND local IN (SELECT local FROM st WHERE call = 'link') UNION SELECT 'key:' || key, local FROM st WHERE call = 'get' AND key IN (SELECT key FROM st WHERE call IN ('create', 'link'))""",
)
def g26(spark, sf):
    t, i = F.col("event_type"), F.col("event_id")
    call = F.when(t == "view", "create").when(t == "click", "link").when(t == "purchase", "prop").when(t == "signup", "set").otherwise("get")
    key = F.concat(F.lit("k"), (i % 97 + F.when(t == "error", 50).otherwise(0)).cast("string"))
    return L.storage_links(X.table(spark, sf, "events").select(call.alias("call"), key.alias("key"), F.concat(F.lit("v"), (i % 31).cast("string")).alias("value"), F.concat(F.lit("l"), (i % 4001).cast("string")).alias("local")))


@query("g29_state_dependencies", sql("x_edges_half", recursive=True, more="w AS (SELECT 'p' || CAST(c_custkey AS VARCHAR) AS root, c_custkey AS node FROM customer WHERE c_acctbal < -950 UNION SELECT root, dst FROM w JOIN x_edges_half ON src = node)", body="SELECT root AS component, node AS state FROM w WHERE node % 3 = 0"))
def g29(spark, sf):
    c = X.table(spark, sf, "customer")
    parts = c.where("c_acctbal < -950").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("component"), F.col("c_custkey").alias("node"))
    return L.state_dependencies(X.x_edges_half(spark, sf), parts, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("node")))


@query(
    "g30_infer_types",
    sql(
        "x_edges_half",
        "n",
        recursive=True,
        more="f AS (SELECT 't' || CAST(n_regionkey AS VARCHAR) AS type, n_nationkey % 5 AS field, 't' || CAST(n_nationkey % 7 AS VARCHAR) AS ft FROM nation), rd AS (SELECT o_custkey AS base, o_orderkey % 5 AS field, o_orderkey % n AS dst FROM orders, n WHERE o_orderkey % 10 = 1), ty AS (SELECT c_custkey AS var, 't' || CAST(c_nationkey % 5 AS VARCHAR) AS type FROM customer WHERE c_custkey % 20 = 0 UNION SELECT x.var, x.type FROM ty, LATERAL (SELECT dst AS var, ty.type AS type FROM x_edges_half WHERE src = ty.var UNION ALL SELECT rd.dst, f.ft FROM rd JOIN f ON f.field = rd.field WHERE rd.base = ty.var AND f.type = ty.type) x)",
        body="SELECT var, type FROM ty",
    ),
)
def g30(spark, sf):
    n = X.customers(spark, sf)
    tag = lambda c: F.concat(F.lit("t"), c.cast("string"))
    c, na, o = (X.table(spark, sf, t) for t in ("customer", "nation", "orders"))
    fields = na.select(tag(F.col("n_regionkey")).alias("type"), (F.col("n_nationkey") % 5).cast("long").alias("field"), tag(F.col("n_nationkey") % 7).alias("field_type"))
    reads = o.where("o_orderkey % 10 = 1").select(F.col("o_custkey").alias("base"), (F.col("o_orderkey") % 5).alias("field"), (F.col("o_orderkey") % n).alias("dst"))
    known = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("var"), tag(F.col("c_nationkey") % 5).alias("type"))
    return L.infer_types(known, X.x_edges_half(spark, sf), fields, reads)


LEFT = "CASE WHEN method % 5 = 0 THEN 'field' ELSE 'local' END"
RIGHT = "CASE WHEN block % 4 = 0 THEN 'new' WHEN block % 4 = 1 THEN 'field' ELSE 'local' END"


@query(
    "g32_pag_edges",
    sql(
        "x_stmts",
        "x_sites",
        more=f"a AS (SELECT method || '.' || def AS l, {LEFT} AS lk, method || '.' || use AS r, {RIGHT} AS rk, 'f' || CAST(block % 2 AS VARCHAR) AS field FROM x_stmts), k AS (SELECT *, CASE WHEN rk = 'new' THEN 'address' WHEN lk = 'field' THEN 'write' WHEN rk = 'field' THEN 'load' ELSE 'copy' END AS kind FROM a)",
        body="SELECT DISTINCT r AS src, l AS dst, kind, CASE WHEN kind IN ('write', 'load') THEN field END AS field FROM k UNION SELECT caller || '.a0', declared || '.' || name || '.p0', 'copy', NULL FROM x_sites UNION SELECT declared || '.' || name || '.ret', caller || '.r', 'copy', NULL FROM x_sites WHERE site % 4 = 0",
    ),
)
def g32(spark, sf):
    s, k = X.x_stmts(spark, sf), X.x_sites(spark, sf)
    name = lambda c: F.concat(F.col("method").cast("string"), F.lit("."), c)
    b = F.col("block") % 4
    assigns = s.select(name("def").alias("left"), F.when(F.col("method") % 5 == 0, "field").otherwise("local").alias("left_kind"), name("use").alias("right"), F.when(b == 0, "new").when(b == 1, "field").otherwise("local").alias("right_kind"), F.concat(F.lit("f"), (F.col("block") % 2).cast("string")).alias("field"))
    callee = F.concat_ws(".", "declared", "name")
    calls = k.select("site", callee.alias("callee"), F.when(F.col("site") % 4 == 0, F.concat("caller", F.lit(".r"))).alias("result"))
    args = k.select("site", F.lit(0).alias("pos"), F.concat("caller", F.lit(".a0")).alias("value"))
    names = k.select(callee.alias("callee")).distinct()
    params = names.select("callee", F.lit(0).alias("pos"), F.concat("callee", F.lit(".p0")).alias("name"))
    return L.pag_edges(assigns, calls, args, params, names.select("callee", F.concat("callee", F.lit(".ret")).alias("value")))
