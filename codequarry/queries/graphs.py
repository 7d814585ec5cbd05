"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import defuse as U
from codequarry.operators import dominance as D
from codequarry.operators import graph as G
from codequarry.operators import trees as T
from codequarry.plans import standins as X
from codequarry.plans.fixpoint import stored
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


@query("g1_build_edges", "SELECT DISTINCT o_custkey AS src, o_orderkey % 40 AS dst, o_orderstatus AS kind FROM orders")
def g1(spark, sf):
    o = X.table(spark, sf, "orders")
    return G.build_edges(o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 40).alias("dst"), F.col("o_orderstatus").alias("kind")))


@query("g1_build_nodes", "SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS attr FROM orders GROUP BY o_custkey")
def g1_nodes(spark, sf):
    o = X.table(spark, sf, "orders")
    return G.build_nodes(o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("attr"), "o_orderkey"), "o_orderkey")


@query("g2_degrees", sql("x_edges_full", body="SELECT id, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM x_edges_full UNION ALL SELECT dst, 1, 0 FROM x_edges_full) GROUP BY id"))
def g2(spark, sf):
    return G.degrees(X.x_edges_full(spark, sf))


@query("g2_roots", sql("x_nodes", "x_edges_full", body="SELECT id, name FROM x_nodes WHERE id NOT IN (SELECT dst FROM x_edges_full)"))
def g2_roots(spark, sf):
    return G.roots(X.x_nodes(spark, sf), X.x_edges_full(spark, sf)).select("id", "name")


@query("g3_connected_components", sql("x_edges_half", recursive=True, more="s AS (SELECT src AS a, dst AS b FROM x_edges_half WHERE src <> dst UNION SELECT dst, src FROM x_edges_half WHERE src <> dst), w AS (SELECT DISTINCT a AS r, a AS v FROM s UNION SELECT r, b FROM w JOIN s ON a = v)", body="SELECT r AS id, min(v) AS component FROM w GROUP BY r"))
def g3(spark, sf):
    return G.connected_components(X.x_edges_half(spark, sf))


CLOSED = "w AS (SELECT src AS r, dst AS v FROM x_edges_full UNION SELECT r, dst FROM w JOIN x_edges_full ON src = v)"
SCC = ", scc AS (SELECT n.id, least(n.id, coalesce(min(a.v), n.id)) AS scc, bool_or(a.r IS NOT NULL) AS in_cycle FROM x_nodes n LEFT JOIN (SELECT a.r, a.v FROM w a JOIN w b ON a.r = b.v AND a.v = b.r) a ON a.r = n.id GROUP BY n.id)"


@query("g4_strong_components", sql("x_nodes", "x_edges_full", recursive=True, more=CLOSED + SCC, body="SELECT id, scc, in_cycle FROM scc"))
def g4(spark, sf):
    return G.strong_components(X.x_nodes(spark, sf), X.x_edges_full(spark, sf))


HALF = (CLOSED + SCC).replace("x_edges_full", "x_edges_half")


@query("g4b_condense_topo", sql("x_nodes", "x_edges_half", recursive=True, more=HALF + ", ce AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM x_edges_half JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc <> b.scc), lv AS (SELECT DISTINCT scc, 0 AS level FROM scc UNION SELECT b, level + 1 FROM lv JOIN ce ON a = scc)", body="SELECT scc, max(level) AS level FROM lv GROUP BY scc"))
def g4b(spark, sf):
    e = X.x_edges_half(spark, sf)
    return G.condense_topo(G.strong_components(X.x_nodes(spark, sf), e), e)


@query("g5_reachable", sql("x_edges_full", recursive=True, more="w AS (SELECT src AS root, src AS node FROM x_edges_full WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal < -950) UNION SELECT root, dst FROM w JOIN x_edges_full ON src = node)", body="SELECT root, node FROM w"))
def g5(spark, sf):
    e = X.x_edges_full(spark, sf)
    asked = X.table(spark, sf, "customer").where("c_acctbal < -950").select(F.col("c_custkey").alias("src"))
    start = e.join(asked, "src", "left_semi").select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    return G.reachable_past_hub(e, start)


SEEN = "seen AS (SELECT DISTINCT method, 1 AS block FROM x_block_rows UNION SELECT c.method, c.dst FROM seen s JOIN x_cfg c ON c.method = s.method AND c.src = s.block)"


@query("g6_unreachable_blocks", sql("x_blocks", "x_cfg", recursive=True, more=SEEN, body="SELECT method, block FROM x_blocks EXCEPT SELECT method, block FROM seen"))
def g6(spark, sf):
    return G.unreachable_blocks(X.x_blocks(spark, sf), X.x_cfg(spark, sf))


# d dominates a block unless some path from the start avoids d
DOMS = SEEN + """, av AS (SELECT s.method, s.block AS d, 1 AS block FROM seen s WHERE s.block <> 1 UNION SELECT c.method, a.d, c.dst FROM av a JOIN x_cfg c ON c.method = a.method AND c.src = a.block WHERE c.dst <> a.d),
    dm AS (SELECT s.method, s.block, d.block AS d FROM seen s JOIN seen d ON d.method = s.method WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.method = s.method AND av.d = d.block AND av.block = s.block)),
    dn AS (SELECT method, block, count(*) AS n FROM dm GROUP BY ALL), idm AS (SELECT dm.method, dm.block, max_by(dm.d, dn.n) AS idom FROM dm JOIN dn ON dn.method = dm.method AND dn.block = dm.d WHERE dm.d <> dm.block GROUP BY ALL)"""
LIVE = ", lc AS (SELECT c.* FROM x_cfg c JOIN seen s ON s.method = c.method AND s.block = c.src)"
DF = LIVE + ", df AS (SELECT DISTINCT dm.method, dm.d AS block, lc.dst AS frontier FROM lc JOIN dm ON dm.method = lc.method AND dm.block = lc.src WHERE NOT EXISTS (SELECT 1 FROM dm x WHERE x.method = dm.method AND x.block = lc.dst AND x.d = dm.d AND x.d <> x.block))"
PHI = DF + ", ph0 AS (SELECT DISTINCT s.method, df.frontier AS block, s.def AS name FROM x_stmts s JOIN df ON df.method = s.method AND df.block = s.block UNION SELECT p.method, df.frontier, p.name FROM ph0 p JOIN df ON df.method = p.method AND df.block = p.block), ph AS (SELECT p.* FROM ph0 p JOIN (SELECT method, dst FROM lc GROUP BY ALL HAVING count(DISTINCT src) > 1) m ON m.method = p.method AND m.dst = p.block)"


def flow(spark, sf):
    return X.x_blocks(spark, sf), X.x_cfg(spark, sf)


@query("g7_dominators", sql("x_blocks", "x_cfg", recursive=True, more=DOMS, body="SELECT method, block, d AS dom FROM dm"))
def g7(spark, sf):
    return D.dominators(*flow(spark, sf))


@query("g7_immediate_dominators", sql("x_blocks", "x_cfg", recursive=True, more=DOMS, body="SELECT method, block, idom FROM idm"))
def g7_idom(spark, sf):
    return D.dominator_tree(*flow(spark, sf)).where("idom is not null").select("method", "block", "idom")


ENCLOSED = DOMS + ", nu AS (SELECT method, block, n - 1 AS depth, (SELECT count(*) FROM dm x WHERE x.method = dn.method AND x.d = dn.block) AS under FROM dn)"


@query("g7_dominance_by_numbers", sql("x_blocks", "x_cfg", recursive=True, more=ENCLOSED, body="SELECT method, block, CAST(depth AS INTEGER) AS depth, CAST(under AS INTEGER) AS under FROM nu"))
def g7_numbers(spark, sf):
    """Depth of each block, and how many it dominates: the numbers of a subtree are consecutive."""
    under = ((F.col("last") - F.col("first") + 1) / 2).cast("int")
    return D.dominator_tree(*flow(spark, sf)).select("method", "block", "depth", under.alias("under"))


@query("g8_dominance_frontier", sql("x_blocks", "x_cfg", recursive=True, more=DOMS + DF, body="SELECT method, block, frontier FROM df"))
def g8(spark, sf):
    return D.dominance_frontier(*flow(spark, sf))


@query("g9_dominance_tree", sql("x_blocks", "x_cfg", recursive=True, more=DOMS + ", pa AS (SELECT method, block, [block] AS path FROM seen WHERE block = 1 UNION ALL SELECT i.method, i.block, path || [i.block] FROM pa JOIN idm i ON i.method = pa.method AND i.idom = pa.block)", body="SELECT pa.method, pa.block, i.idom AS parent, CAST(row_number() OVER (PARTITION BY pa.method ORDER BY path) AS INTEGER) AS place FROM pa LEFT JOIN idm i ON i.method = pa.method AND i.block = pa.block"))
def g9(spark, sf):
    return D.dominance_tree(D.dominator_tree(*flow(spark, sf)))


def defs_uses(spark, sf):
    s = X.x_stmts(spark, sf)
    return s.select("method", "block", F.col("def").alias("name")), s.select("method", "block", F.col("use").alias("name"))


def live_cfg(spark, sf, tree):
    return X.x_cfg(spark, sf).join(tree.select("method", F.col("block").alias("src")), ["method", "src"], "left_semi")


def phis(spark, sf, tree):
    return D.phi_sites(defs_uses(spark, sf)[0], D.dominance_frontier(*flow(spark, sf)), live_cfg(spark, sf, tree))


@query("g10_phi_sites", sql("x_blocks", "x_cfg", "x_stmts", recursive=True, more=DOMS + PHI, body="SELECT method, block, name FROM ph"))
def g10(spark, sf):
    return phis(spark, sf, D.dominator_tree(*flow(spark, sf)))


SITES = DOMS + PHI + ", si AS (SELECT *, row_number() OVER (PARTITION BY method, name ORDER BY block, kind) AS version FROM (SELECT method, block, name, 0 AS kind FROM ph UNION ALL SELECT method, block, def, 1 FROM x_stmts))"


def versioned(spark, sf):
    """Definitions, uses, the live edges, the dominator tree and the merges; items are read and sorted once."""
    rows = X.x_methods_once(spark, sf)
    blocks, cfg = rows.select("method", "block"), rows.select("method", F.col("block").alias("src"), F.explode(F.array_distinct("tos")).alias("dst"))
    tree = D.dominator_tree(blocks, cfg)
    live = cfg.join(tree.select("method", F.col("block").alias("src")), ["method", "src"], "left_semi")
    defs, uses = (rows.select("method", "block", F.col(c).alias("name")) for c in ("def", "use"))
    return defs, uses, live, tree, stored(D.phi_sites(defs, D.dominance_frontier(blocks, cfg), live))


@query(
    "g11_version_variables",
    sql(
        "x_blocks",
        "x_cfg",
        "x_stmts",
        recursive=True,
        more=SITES,
        body="SELECT u.method, u.block, u.use AS name, CAST(coalesce(max_by(si.version, dn.n * 2 + si.kind) FILTER (si.version IS NOT NULL), 0) AS INTEGER) AS version FROM x_stmts u JOIN dm ON dm.method = u.method AND dm.block = u.block JOIN dn ON dn.method = dm.method AND dn.block = dm.d LEFT JOIN si ON si.method = u.method AND si.block = dm.d AND si.name = u.use AND (si.kind = 0 OR dm.d <> u.block) GROUP BY ALL",
    ),
)
def g11(spark, sf):
    defs, uses, _, tree, found = versioned(spark, sf)
    return D.version_variables(defs, uses, found, tree)


@query(
    "g11_phi_arguments",
    sql(
        "x_blocks",
        "x_cfg",
        "x_stmts",
        recursive=True,
        more=SITES,
        body="SELECT p.method, p.block, p.name, lc.src AS pred, CAST(coalesce(max_by(si.version, dn.n * 2 + si.kind) FILTER (si.version IS NOT NULL), 0) AS INTEGER) AS version FROM ph p JOIN lc ON lc.method = p.method AND lc.dst = p.block JOIN dm ON dm.method = lc.method AND dm.block = lc.src JOIN dn ON dn.method = dm.method AND dn.block = dm.d LEFT JOIN si ON si.method = p.method AND si.block = dm.d AND si.name = p.name GROUP BY ALL",
    ),
)
def g11_arguments(spark, sf):
    defs, _, cfg, tree, found = versioned(spark, sf)
    return D.phi_arguments(defs, found, tree, cfg)


@query(
    "g12_def_use_chains",
    sql(
        "x_cfg",
        "x_stmts",
        recursive=True,
        more="w AS (SELECT s.method, s.block AS use_block, s.use AS name, c.src AS at_ FROM x_stmts s JOIN x_cfg c ON c.method = s.method AND c.dst = s.block UNION SELECT w.method, w.use_block, w.name, c.src FROM w JOIN x_stmts s ON s.method = w.method AND s.block = w.at_ AND s.def <> w.name JOIN x_cfg c ON c.method = w.method AND c.dst = w.at_)",
        body="SELECT w.method, w.name, w.at_ AS def_block, w.use_block FROM w JOIN x_stmts s ON s.method = w.method AND s.block = w.at_ AND s.def = w.name",
    ),
)
def g12(spark, sf):
    defs, uses = defs_uses(spark, sf)
    return U.def_use_chains(defs, uses, X.x_cfg(spark, sf))


@query(
    "g12_statement_chains",
    sql(
        "x_code_statements",
        recursive=True,
        more="""cs AS MATERIALIZED (SELECT * FROM x_code_statements), ce AS MATERIALIZED (SELECT DISTINCT method, block AS src, unnest(tos) AS dst FROM cs WHERE idx = 0),
        ed AS MATERIALIZED (SELECT ce.* FROM ce JOIN (SELECT DISTINCT method, block FROM cs) b ON b.method = ce.method AND b.block = ce.dst), nd AS MATERIALIZED (SELECT u.method, u.block, u.idx, u.use AS name, max(d.idx) AS def_idx FROM cs u LEFT JOIN cs d ON d.method = u.method AND d.block = u.block AND d.idx < u.idx AND d.def = u.use GROUP BY ALL),
        la AS MATERIALIZED (SELECT method, block, def AS name, max(idx) AS idx FROM cs GROUP BY ALL), w AS (SELECT DISTINCT n.method, n.block AS use_block, n.name, e.src AS at_ FROM nd n JOIN ed e ON e.method = n.method AND e.dst = n.block WHERE n.def_idx IS NULL
        UNION SELECT w.method, w.use_block, w.name, e.src FROM w JOIN ed e ON e.method = w.method AND e.dst = w.at_ WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.method = w.method AND la.block = w.at_ AND la.name = w.name))""",
        body="SELECT method, name, block AS def_block, def_idx, block AS use_block, idx AS use_idx FROM nd WHERE def_idx IS NOT NULL UNION ALL SELECT n.method, n.name, la.block, la.idx, n.block, n.idx FROM nd n JOIN w ON w.method = n.method AND w.use_block = n.block AND w.name = n.name JOIN la ON la.method = w.method AND la.block = w.at_ AND la.name = w.name WHERE n.def_idx IS NULL",
    ),
)
def g12_statements(spark, sf):
    """Blocks of five statements; a method is the items of eight orders."""
    rows = X.x_code_statements(spark, sf)
    defs = rows.select("method", "block", "idx", F.col("def").alias("name"))
    uses = rows.select("method", "block", "idx", F.col("use").alias("name"))
    blocks = rows.select("method", F.col("block").alias("dst")).distinct()
    edges = rows.where("idx = 0").select("method", F.col("block").alias("src"), F.explode("tos").alias("dst")).join(blocks, ["method", "dst"], "left_semi")
    return U.statement_chains(defs, uses, edges)


@query("g27_tree_walk", sql("x_tree", recursive=True, more="h AS (SELECT root, node FROM x_tree WHERE state = 's1' UNION SELECT h.root, t.parent FROM h JOIN x_tree t ON t.root = h.root AND t.node = h.node WHERE t.parent IS NOT NULL)", body="SELECT t.root, t.node, h.node IS NOT NULL AS found FROM x_tree t LEFT JOIN h ON h.root = t.root AND h.node = t.node"))
def g27(spark, sf):
    return G.tree_walk(X.x_tree(spark, sf), F.col("state") == "s1")


@query("u4_node_predicate", sql("x_tree", recursive=True, more="h AS (SELECT root, node FROM x_tree WHERE kind = 'assistant' AND state <> 's0' UNION SELECT h.root, t.parent FROM h JOIN x_tree t ON t.root = h.root AND t.node = h.node WHERE t.parent IS NOT NULL)", body="SELECT root, count(*) AS nodes FROM h GROUP BY root"))
def u4(spark, sf):
    """How many nodes of a tree hold one that meets a condition of two columns."""
    found = G.tree_walk(X.x_tree(spark, sf), (F.col("kind") == "assistant") & (F.col("state") != "s0"))
    return found.where("found").groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


HOLDERS = ["Column", "Row"]
# calls in order, bodies put in; then call by call with the open nodes as a list
SCAN = """op AS (SELECT root, [ord] AS path, op, name, callee FROM x_tree_ops UNION ALL SELECT p.root, list_append(p.path, o.ord), o.op, o.name, o.callee FROM op p JOIN x_tree_ops o ON p.op = 'loop' AND o.root = p.callee),
    nu AS (SELECT root, path, op, CASE op WHEN 'branch' THEN 'IfBranch' WHEN 'builder' THEN 'Builder' WHEN 'component' THEN 'View' ELSE name END AS name, callee, row_number() OVER (PARTITION BY root ORDER BY path) AS i FROM op),
    sc AS (SELECT root, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(path BIGINT[], name VARCHAR)[]) AS st, CAST(NULL AS BIGINT[]) AS parent FROM nu WHERE i = 1 UNION ALL
        SELECT root, i, CASE WHEN op IN ('pop', 'builder') THEN st ELSE list_append(st, {'path': path, 'name': name}) END, CASE WHEN op <> 'pop' THEN st[-1].path END FROM (
        SELECT root, i, op, path, name, CASE WHEN op = 'pop' OR len(st) = 0 OR list_contains(['Column', 'Row', 'If', 'IfBranch', 'Builder', 'View', 'Repeat'], st[-1].name) THEN st ELSE st[1:len(st) - 1] END AS st FROM (
        SELECT root, i, op, path, name, CASE WHEN op = 'pop' AND name = 'If' THEN st[1:greatest(k - 1, 0)] WHEN op = 'pop' THEN CASE WHEN st[-1].name = name THEN st[1:len(st) - 1] ELSE st END WHEN op = 'branch' THEN st[1:k] ELSE st END AS st FROM (
        SELECT n.*, s.st, coalesce(list_max(list_transform(range(1, len(s.st) + 1), lambda x: CASE WHEN s.st[x].name = 'If' THEN x ELSE 0 END)), 0) AS k FROM sc s JOIN nu n ON n.root = s.root AND n.i = s.i + 1)))),
    ow AS (SELECT n.*, s.parent FROM nu n JOIN sc s ON s.root = n.root AND s.i = n.i WHERE n.op <> 'pop'),
    tr AS (SELECT root, path AS place, name, parent, op, callee FROM ow UNION ALL
        SELECT t.root, list_concat(t.place, [-1], o.path), o.name, CASE WHEN o.parent IS NULL THEN t.place ELSE list_concat(t.place, [-1], o.parent) END, o.op, o.callee FROM tr t JOIN ow o ON t.op IN ('builder', 'component') AND o.root = t.callee)"""


@query("g28_assemble_component_tree", sql("x_tree_ops", recursive=True, more=SCAN, body="SELECT root, array_to_string(place, '.') AS place, name, array_to_string(parent, '.') AS parent FROM tr"))
def g28(spark, sf):
    t = T.assemble_component_tree(X.x_tree_ops(spark, sf), HOLDERS)
    dotted = lambda c: F.array_join(F.col(c).cast("array<string>"), ".").alias(c)
    return t.select("root", dotted("place"), "name", dotted("parent"))


@query("g28_shape_of_trees", sql("x_tree_ops", recursive=True, more=SCAN + ", d AS (SELECT root, place, 0 AS depth FROM tr WHERE parent IS NULL UNION ALL SELECT t.root, t.place, depth + 1 FROM d JOIN tr t ON t.root = d.root AND t.parent = d.place)", body="SELECT root, CAST(max(depth) AS INTEGER) AS depth, count(*) AS nodes FROM d GROUP BY root"))
def g28_shape(spark, sf):
    """Depth and size of each tree, with segments of one conversation each."""
    t = T.with_depth(T.assemble_component_tree(X.x_tree_ops(spark, sf), HOLDERS, segment=1000))
    return t.groupBy("root").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes"))


# a page's links lead to other pages by their numbers
IMPORTED = "e AS (SELECT DISTINCT file AS src, CASE WHEN ord % 2 = 0 THEN target ELSE (file * 3 + ord) % (SELECT count(*) FROM pages) END AS dst FROM x_imports)"


def imported(spark, sf):
    n = X.table(spark, sf, "pages").count()
    return X.x_imports(spark, sf).select(F.col("file").alias("src"), F.when(F.col("ord") % 2 == 0, F.col("target")).otherwise((F.col("file") * 3 + F.col("ord")) % n).alias("dst")).distinct()


@query(
    "g31_dependency_order",
    sql(
        "x_imports",
        recursive=True,
        more=IMPORTED + ", w AS (SELECT page_id AS root, page_id AS node, 0 AS hops FROM pages WHERE url LIKE '%#top' UNION SELECT root, dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 40)",
        body="SELECT root, node, min(hops) AS hops FROM w GROUP BY root, node",
    ),
)
def g31_order(spark, sf):
    start = X.table(spark, sf, "pages").where("url like '%#top'").select(F.col("page_id").alias("id"))
    return G.dependency_order(imported(spark, sf), start)


@query(
    "g31_import_cycles",
    sql(
        "x_imports",
        recursive=True,
        more=IMPORTED + ", w AS (SELECT src AS r, dst AS v FROM e UNION SELECT r, dst FROM w JOIN e ON src = v)",
        body="SELECT a.r AS id, min(a.v) AS scc FROM w a JOIN w b ON a.r = b.v AND a.v = b.r GROUP BY a.r",
    ),
)
def g31(spark, sf):
    e = imported(spark, sf)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return G.import_cycles(e, nodes)
