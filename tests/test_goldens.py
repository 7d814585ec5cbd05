"""Small graphs and texts worked by hand, and invariants."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from codequarry.operators import calls, declarations, dominance, flow, graph, joins, pointers, repair, retrieve, rounds, text, tracking, trees, windows
from codequarry.plans.fixpoint import fixpoint
from codequarry.sources import io

CYCLE = "ef ec de cd ba bc ab fc fd fg".split()


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_strong_components_of_a_call_cycle(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "id string")
    edges = spark.createDataFrame([tuple(e) for e in CYCLE], "src string, dst string")
    found = {r["id"]: (r["scc"], r["in_cycle"]) for r in graph.strong_components(nodes, edges).collect()}
    assert found == {"a": ("a", True), "b": ("a", True), "c": ("c", True), "d": ("c", True), "e": ("c", True), "f": ("c", True), "g": ("g", False)}
    levels = dict(graph.condense_topo(graph.strong_components(nodes, edges), edges).collect())
    assert levels == {"a": 0, "c": 1, "g": 2}


def test_dispatch_by_hierarchy_and_by_instantiation(spark):
    classes = spark.createDataFrame([("Animal", True), ("Dog", False), ("Cat", False), ("Pig", False), ("main", False)], "class string, abstract boolean")
    extends = spark.createDataFrame([(c, "Animal") for c in ("Dog", "Cat", "Pig")], "child string, parent string")
    methods = spark.createDataFrame([(c, "makeSound", False) for c in ("Dog", "Cat", "Pig")] + [("Animal", "makeSound", True)], "class string, name string, abstract boolean")
    sites = spark.createDataFrame([(1, "main", "Animal", "makeSound")], "site int, caller string, declared string, name string")
    entries = spark.createDataFrame([("main",)], "class string")
    found = calls.targets(sites, calls.subclasses(extends, classes), classes, methods)
    by_hierarchy = pairs(calls.calls_by_hierarchy(found, entries).select("callee"))
    creates = spark.createDataFrame([("main", "Dog"), ("main", "Cat"), ("elsewhere", "Pig")], "caller string, class string")
    by_creation = pairs(calls.calls_by_instantiation(found, creates, entries).select("callee"))
    assert by_hierarchy == {("Dog",), ("Cat",), ("Pig",)} and by_creation == {("Dog",), ("Cat",)}


def diamond(spark):
    blocks = spark.createDataFrame([("m", b) for b in (1, 2, 3, 4, 9)], "method string, block int")
    cfg = spark.createDataFrame([("m", a, b) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4), (9, 4))], "method string, src int, dst int")
    return blocks, cfg


def test_dominance_on_a_diamond(spark):
    blocks, cfg = diamond(spark)
    assert pairs(dominance.dominators(blocks, cfg).select("block", "dom")) == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (4, 4)}
    tree = dominance.dominator_tree(blocks, cfg)
    assert pairs(tree.select("block", "idom", "depth")) == {(1, None, 0), (2, 1, 1), (3, 1, 1), (4, 1, 1)}
    live = cfg.where("src <> 9")
    frontier = dominance.dominance_frontier(blocks, cfg)
    assert pairs(frontier.select("block", "frontier")) == {(2, 4), (3, 4)}
    defs = spark.createDataFrame([("m", 2, "x"), ("m", 3, "x"), ("m", 1, "y")], "method string, block int, name string")
    phis = dominance.phi_sites(defs, frontier, live)
    assert pairs(phis.select("block", "name")) == {(4, "x")}
    uses = spark.createDataFrame([("m", 4, "x"), ("m", 4, "y"), ("m", 2, "x")], "method string, block int, name string")
    versions = pairs(dominance.version_variables(defs, uses, phis, tree).select("block", "name", "version"))
    assert versions == {(4, "x", 3), (4, "y", 1), (2, "x", 0)}
    assert pairs(dominance.phi_arguments(defs, phis, tree, live).select("block", "name", "pred", "version")) == {(4, "x", 2, 1), (4, "x", 3, 2)}
    assert pairs(graph.unreachable_blocks(blocks, cfg).select("block")) == {(9,)}


def brute_points_to(rows):
    pts, changed = set(), True
    while changed:
        new = set()
        for s, d, kind, f in rows:
            if kind == "address":
                new.add((d, s))
            if kind == "copy":
                new |= {(d, o) for v, o in pts if v == s}
            if kind == "load":
                new |= {(d, x) for v, o in pts if v == s for c, x in pts if c == (o, f)}
            if kind == "write":
                new |= {((o, f), x) for v, o in pts if v == d for w, x in pts if w == s}
        changed = not new <= pts
        pts |= new
    return {(v, o) for v, o in pts if not isinstance(v, tuple)}


def test_points_to_with_fields(spark):
    rows = [(-1, 1, "address", 0), (-2, 2, "address", 0), (-3, 6, "address", 0), (1, 3, "copy", 0), (2, 3, "write", 0), (1, 4, "load", 0), (1, 5, "load", 1), (6, 1, "write", 1), (5, 7, "copy", 0), (7, 5, "copy", 0)]
    pag = spark.createDataFrame(rows, "src long, dst long, kind string, field long")
    points = flow.variables(flow.points_to(pag))
    assert pairs(points) == brute_points_to(rows) and (4, -2) in pairs(points)
    alias = spark.createDataFrame([(1, 3), (2, 4), (1, 2)], "a long, b long")
    assert pairs(flow.may_alias(alias, points)) == {(1, 3), (2, 4)}


def test_call_strings_are_cut(spark):
    pag = spark.createDataFrame([(-1, 1, "address")], "src long, dst long, kind string")
    passed = spark.createDataFrame([(1, 2, 10), (2, 3, 20), (3, 4, 30)], "src long, dst long, callee long")
    found = {r["var"]: r["ctx"] for r in flow.points_to_ctx(pag, passed, 2).collect()}
    assert found == {1: [], 2: [10], 3: [20, 10], 4: [30, 20]}


def test_facts_return_only_to_their_caller(spark):
    # node 10 enters callee 50 with fact a, node 20 with fact b; the callee's end is 51
    make = lambda rows, s: spark.createDataFrame(rows, s)
    seeds = make([(1, "x"), (2, "y")], "node long, fact string")
    normal = make([(1, "x", 10, "x"), (2, "y", 20, "y"), (50, "a", 51, "a"), (50, "b", 51, "b")], "node long, fact string, to long, fact_to string")
    into = make([(10, "x", 50, "a"), (20, "y", 50, "b")], "node long, fact string, start long, start_fact string")
    back = make([(51, f, c, t, f) for f, (c, t) in product("ab", ((10, 11), (20, 21)))], "node long, fact string, call long, to long, fact_to string")
    found = pairs(flow.dataflow_reach(seeds, normal, into, back).select("node", "fact"))
    assert {(11, "a"), (21, "b")} <= found and not {(11, "b"), (21, "a")} & found


def test_by_instantiation_is_part_of_by_hierarchy(spark):
    from codequarry.queries.programs import QUERIES

    sf = "/root/testdata/sf0.001"
    assert pairs(QUERIES["g16_calls_by_instantiation"](spark, sf)) <= pairs(QUERIES["g15_calls_by_hierarchy"](spark, sf))


def test_merged_ranges_are_apart(spark):
    rows = spark.createDataFrame([("p", 1, 3), ("p", 4, 4), ("p", 6, 9), ("p", 7, 7), ("q", 2, 2)], "path string, start int, end int")
    assert pairs(windows.merge_ranges(rows).select("path", "start", "end")) == {("p", 1, 4), ("p", 6, 9), ("q", 2, 2)}


def test_brackets_like_a_stack(spark):
    import random

    random.seed(1)
    files = ["".join(random.choice("(){}[]") for _ in range(random.randint(0, 14))) for _ in range(60)]
    lines = spark.createDataFrame([(k, 1, t) for k, t in enumerate(files)], "path int, line_no int, text string")
    want = set()
    for k, t in enumerate(files):
        stack = []
        for i, c in enumerate(t):
            if c in text.BRACKETS:
                stack.append((i, c))
            elif not stack:
                want.add((k, i, "extra"))
            elif text.BRACKETS[stack.pop()[1]] != c:
                want.add((k, i, "mismatched"))
        want |= {(k, i, "unclosed") for i, _ in stack}
    assert pairs(text.bracket_report(lines).select("path", "k", "problem")) == want


def test_diff_text_gives_back_the_second_text(spark):
    rows = spark.createDataFrame([("k", "a\nb\n\nc", "a\nx\nc\nd")], "key string, a string, b string")
    diff = text.line_diff_text(rows, "a", "b").first()["diff"]
    kept = [x[2:] for x in diff.split("\n") if not x.startswith("-")]
    assert kept == ["a", "x", "c", "d"]


def test_retries_and_gate(spark):
    tries = spark.createDataFrame([("a", 1, False, "a1"), ("a", 2, True, "a2"), ("a", 3, True, "a3"), ("b", 1, False, "b1")], "key string, attempt int, success boolean, text string")
    files = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "key string, text string")
    assert pairs(repair.retry_until(tries, files)) == {("a", "a2", True), ("b", "B", False), ("c", "C", False)}


def test_answers_are_tried_again(spark):
    def make():
        seen = {}

        def reply(p):
            seen[p] = seen.get(p, 0) + 1
            if p == "never" or seen[p] < 2:
                raise ValueError("busy")
            return p.upper()

        return reply

    out = {r["prompt"]: (r["reply"], r["error"]) for r in repair.answer(spark.createDataFrame([("once",), ("never",)], "prompt string").coalesce(1), make).collect()}
    assert out == {"once": ("ONCE", None), "never": (None, "ValueError: busy")}


def test_global_rank_is_a_total_order(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    assert all(r["rn"] == r["k"] + 1 for r in windows.global_rank(rows, "k").collect())


def test_fixpoint_stops_after_the_rounds_asked_for(spark):
    assert fixpoint(spark.range(1), lambda d, _: d.select((F.col("id") + 1).alias("id")), ["id"], rounds=3).count() == 4


def test_program_facts_flatten_and_nest(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"file": "a.ets", "classes": [{"name": "C", "superclass": null, "type": "{\\"tag\\": \\"union\\"}", "methods": [{"name": "m", "modifiers": 4, "blocks": [{"id": 0, "successors": [1, 2], "stmts": [{"kind": "assign", "def": "x", "uses": ["y"], "callee": null, "args": []}]}, {"id": 1, "successors": [], "stmts": []}]}]}, {"name": "Empty"}]}\n')
    facts = io.read_program_facts(spark, str(tmp_path))
    assert pairs(facts["cfg_edges"]) == {("a.ets.C.m", 0, 1), ("a.ets.C.m", 0, 2)}
    assert facts["classes"].count() == 2 and facts["methods"].count() == 1
    assert facts["blocks"].where("is_start").count() == 1 and facts["stmts"].first()["def"] == "x"


def test_outside_blocks_and_overlaps(spark):
    lines = spark.createDataFrame([("p", k) for k in range(1, 8)], "path string, line_no int")
    blocks = spark.createDataFrame([("p", 2, 3), ("p", 6, 6)], "path string, head int, end int")
    assert pairs(joins.outside_blocks(lines, blocks).select("line_no")) == {(1,), (4,), (5,), (7,)}
    ranges = spark.createDataFrame([("p", 1, 1, 5000), ("p", 2, 5001, 5001), ("p", 3, 5003, 9000), ("q", 4, 1, 9)], "path string, id int, start int, end int")
    assert pairs(joins.overlapping_findings(ranges).select("a", "b")) == {(1, 2)}


def test_groups_of_documents_stay_small(spark, tmp_path, monkeypatch):
    from codequarry.queries import linking, tables

    docs = [(k, "\n".join(f"d{k} line {j}" for j in range(250 if k < 3 else 2)), "hot") for k in range(2_500)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = tables.w10(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split(".")[0], r["k"]) for r in out) == [(f"hot/{d}", k) for d in (1, 2) for k in (1, 2)]  # document 0 is emptied
    assert all(r["prev"] + "\n" + r["target"] == docs[int(r["path"][4])][1] for r in out)
    monkeypatch.setattr(linking, "new_path", lambda spark, label: str(tmp_path / label))
    got = linking.s5(spark, str(tmp_path))
    assert sorted(int(r["rule"].split("/")[1]) for r in got.collect()) == list(range(2_500))
    sizes = [r["n"] for r in spark.read.text(str(tmp_path / "rules")).select(F.size(F.split("value", '"errorLocation"')).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 1_200


def test_total_order_keeps_all_rows_over_many_parts(spark):
    """Wide rows and a small advisory size, which made uses of one plan see other parts."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(30_000, numPartitions=24).select((F.col("id") * 7919 % 30_011).alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("wide"))
        out = windows.global_rank(rows.repartition(48), "k").select("k", "rn").toPandas().sort_values("k")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert out["rn"].tolist() == list(range(1, 30_001))


def test_reachability_follows_long_chains(spark):
    n = 1_500
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0, 0), (1_490, 1_490)], "root long, node long")
    found = {(r["root"], r["c"], r["m"]) for r in graph.reachable(chain, start).groupBy("root").agg(F.countDistinct("node").alias("c"), F.max("node").alias("m")).collect()}
    assert found == {(0, n + 1, n), (1_490, 11, n)}


def test_reachability_goes_on_when_jumps_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_JUMPS", 0)
    chain = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0, 0)], "root long, node long")
    assert graph.reachable(chain, start).count() == 31


def test_dependency_order_gives_the_fewest_imports(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (4, 1)], "src long, dst long")
    out = graph.dependency_order(edges, spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, out.select("root", "node", "hops").collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 1)]


def test_dominance_agrees_with_brute_force(spark):
    rng = random.Random(7)
    edges = [(m, rng.randint(1, 9), rng.randint(1, 9)) for m in range(60) for _ in range(rng.randint(0, 16))]
    blocks = spark.createDataFrame([(m, b) for m in range(60) for b in range(1, 10)], "method long, block int")
    cfg = spark.createDataFrame(edges, "method long, src int, dst int")

    def reach(m, without):
        seen = {1} - {without}
        while more := {d for n, s, d in edges if n == m and s in seen} - seen - {without}:
            seen |= more
        return seen

    want = {(m, b, d) for m in range(60) for b in reach(m, 0) for d in range(1, 10) if d == b or b not in reach(m, d)}
    assert pairs(dominance.dominators(blocks, cfg)) == want
    tree = dominance.dominator_tree(blocks, cfg).collect()
    assert {(b.method, b.block, a.block) for a in tree for b in tree if a.method == b.method and a.first <= b.first and b.last <= a.last} == want
    ends = {(m, x, d) for m, s, d in edges if s in reach(m, 0) for x in range(1, 10) if (m, s, x) in want and not ((m, d, x) in want and x != d)}
    assert pairs(dominance.dominance_frontier(blocks, cfg)) == ends


def test_versions_agree_with_renaming_along_the_tree(spark):
    rng = random.Random(11)
    edges = sorted({(m, rng.randint(1, 8), rng.randint(1, 8)) for m in range(30) for _ in range(14)})
    blocks = spark.createDataFrame([(m, b) for m in range(30) for b in range(1, 9)], "method long, block int")
    cfg = spark.createDataFrame(edges, "method long, src int, dst int")
    rows = [(m, b, f"v{rng.randint(0, 2)}", f"v{rng.randint(0, 2)}") for m in range(30) for b in range(1, 9)]
    defs = spark.createDataFrame([(m, b, d) for m, b, d, _ in rows], "method long, block int, name string")
    uses = spark.createDataFrame([(m, b, u) for m, b, _, u in rows], "method long, block int, name string")
    tree = dominance.dominator_tree(blocks, cfg)
    live = cfg.join(tree.select("method", F.col("block").alias("src")), ["method", "src"], "left_semi")
    phis = dominance.phi_sites(defs, dominance.dominance_frontier(blocks, cfg), live)
    above, merges = {(r.method, r.block): r.idom for r in tree.collect()}, pairs(phis)
    number = {}
    for m in range(30):
        for name in ("v0", "v1", "v2"):
            sites = sorted([(b, 0) for n, b, x in merges if (n, x) == (m, name)] + [(b, 1) for n, b, d, _ in rows if (n, d) == (m, name)])
            number |= {(m, name, *site): k for k, site in enumerate(sites, 1)}

    def held(m, name, block, kinds):
        while block is not None:
            found = [number[m, name, block, k] for k in kinds if (m, name, block, k) in number]
            if found:
                return found[0]
            block, kinds = above[m, block], (1, 0)
        return 0

    assert pairs(dominance.version_variables(defs, uses, phis, tree)) == {(m, b, u, held(m, u, b, (0,))) for m, b, _, u in rows if (m, b) in above}
    want = {(m, d, x, s, held(m, x, s, (1, 0))) for m, s, d in edges if (m, s) in above for n, b, x in merges if (n, b) == (m, d)}
    assert pairs(dominance.phi_arguments(defs, phis, tree, live)) == want and len(want) > 50


@pytest.mark.parametrize("shape", ["chain", "ladder", "rings"])
def test_dominance_of_a_method_of_many_blocks_ends(spark, shape):
    n = 100_000
    step = {"chain": lambda i: [i + 1], "ladder": lambda i: [i + 1, i + 2] if i % 2 else [i + 2], "rings": lambda i: [i + 1, max(1, i - 2)]}[shape]
    edges = spark.range(1, n + 1).rdd.flatMap(lambda r: [(1, r[0], d) for d in step(r[0]) if d <= n]).toDF("method long, src long, dst long")
    tree = dominance.dominator_tree(spark.range(1, n + 1).selectExpr("1L AS method", "id AS block"), edges)
    assert tree.count() == n
    assert tree.where("block = 1").first()["last"] == 2 * n
    deepest = tree.agg(F.max("depth")).first()[0]
    assert deepest == (n // 2 - 1 if shape == "ladder" else n - 1)


def test_innermost_scope_over_many_cells(spark):
    heads = [(1, 900, "component"), (2, 500, "build"), (3, 3, "block"), (60, 61, "arrow"), (63, 64, "arrow"), (65, 200, "function"), (600, 700, "block")]
    lines = spark.createDataFrame([("f", n, "x") for n in range(1, 950)], "path string, line_no int, text string")
    out = declarations.innermost(lines, spark.createDataFrame([("f", *h) for h in heads], "path string, head int, end int, kind string"))
    for r in out.collect():
        around = [h for h in heads if h[0] < r.line_no <= h[1]]
        assert (r.head, r.scope) == ((max(around)[0], max(around)[2]) if around else (None, None))


def drawn(tree, root):
    """A tree as nested text, children in order of their places."""
    rows = [r for r in tree.collect() if r["root"] == root]
    below = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        below.setdefault(tuple(r["parent"]) if r["parent"] is not None else None, []).append(r)
    text = lambda at: " ".join(r["name"] + (f"({inner})" if (inner := text(tuple(r["place"]))) else "") for r in below.get(at, []))
    return text(None)


def tree_of(spark, roots, bindings=None, segment=1000):
    rows = [(root, k, *(*call.split("/"), None, None)[:3]) for root, calls in roots.items() for k, call in enumerate(calls.split())]
    ops = spark.createDataFrame(rows, "root string, ord long, op string, name string, callee string")
    given = None if bindings is None else spark.createDataFrame(bindings, "root string, ord long, slot string, callee string")
    return trees.assemble_component_tree(ops, ["Column", "Row", "ForEach", "Grid"], given, segment)


TREES = {
    # a node that holds nothing is closed by the next; a pop by another name does nothing
    "names": ({"a": "create/Column create/Text create/Text pop/Column"}, "Column(Text Text)"),
    "pop of another": ({"a": "create/Column create/Row pop/Column create/Text pop/Row create/Text"}, "Column(Row(Text Text))"),
    "if": ({"a": "create/Column create/Text pop/Text create/If branch create/Text pop/Text create/If branch create/Text branch create/Text pop/If branch create/Text pop/If create/Text create/Button"}, "Column(Text If(IfBranch(Text If(IfBranch(Text) IfBranch(Text))) IfBranch(Text)) Text Button)"),
    "pop of if closes what is open": ({"a": "create/Column create/If branch create/Row create/Text pop/If create/Text"}, "Column(If(IfBranch(Row(Text))) Text)"),
    "loop": ({"a": "create/Column loop/ForEach/body pop/ForEach create/Text", "body": "create/Row create/Text pop/Text pop/Row"}, "Column(ForEach(Row(Text)) Text)"),
    "each": ({"a": "create/Column create/Repeat each/-/body create/Text", "body": "create/Row"}, "Column(Repeat(Row Text))"),
    "builder": ({"a": "create/Column create/Text builder/-/b create/Text", "b": "create/Row create/Text pop/Text pop/Row create/Text"}, "Column(Text Builder(Row(Text) Text) Text)"),
    "component": ({"a": "create/Column component/-/c pop/View create/Text", "c": "create/Grid builder/-/d", "d": "create/Text"}, "Column(View(Grid(Builder(Text))) Text)"),
    "itself": ({"a": "create/Column builder/-/a create/Text"}, "Column(Builder Text)"),
    "pops of nothing": ({"a": "pop/Column pop/If create/Text pop/Text create/Text"}, "Text Text"),
}


@pytest.mark.parametrize("segment", [1000, 2, 1])
def test_component_trees(spark, segment):
    """All cases at once, read whole and in segments of two calls and of one."""
    clean = {}
    for case, (them, _) in TREES.items():
        key = case.replace(" ", "_")
        for root, calls in them.items():
            clean[f"{key}:{root}"] = " ".join(c if c.count("/") < 2 else f"{c.rsplit('/', 1)[0]}/{key}:{c.rsplit('/', 1)[1]}" for c in calls.split())
    tree = tree_of(spark, clean, segment=segment)
    for case, (_, want) in TREES.items():
        assert drawn(tree, f"{case.replace(' ', '_')}:a") == want, case


def test_builder_parameters_are_filled_by_the_caller(spark):
    roots = {"a": "create/Column component/-/c pop/View component/-/c", "c": "create/Grid slot/content", "x": "create/Text", "y": "create/Row create/Button"}
    tree = tree_of(spark, roots, [("a", 1, "content", "x"), ("a", 3, "content", "y")])
    assert drawn(tree, "a") == "Column(View(Grid(content(Text))) View(Grid(content(Row(Button)))))"
    assert drawn(tree, "c") == "Grid(content)"


def test_component_trees_by_segments_equal_a_stack(spark):
    rng = random.Random(2)
    names = ["Column", "Row", "Text", "If", "Button"]
    calls = {f"r{k}": [f"{rng.choice(['create', 'create', 'pop', 'pop', 'branch'])}/{rng.choice(names)}" for _ in range(120)] for k in range(8)}

    def by_stack(ops):
        stack, parents = [], {}
        for k, call in enumerate(ops):
            op, name = call.split("/")
            if op == "pop" and name == "If" or op == "branch":
                while stack and stack[-1][1] != "If":
                    stack.pop()
                if op == "pop" and stack:
                    stack.pop()
            elif op == "pop" and stack and stack[-1][1] == name:
                stack.pop()
            if op != "pop":
                if stack and stack[-1][1] not in ("Column", "Row", "If", "IfBranch"):
                    stack.pop()
                parents[k] = stack[-1][0] if stack else None
                stack.append((k, "IfBranch" if op == "branch" else name))
        return parents

    for segment in (1000, 7):
        tree = tree_of(spark, {r: " ".join(c) for r, c in calls.items()}, segment=segment).collect()
        for r, ops in calls.items():
            assert {t["place"][0]: t["parent"][0] if t["parent"] else None for t in tree if t["root"] == r} == by_stack(ops)


def on_the_fly(spark, k, **tables):
    schemas = {
        "statements": "method long, kind string, src long, dst long, field long", "calls": "site long, method long, callee long, base long, name string, result long", "args": "site long, pos int, value long",
        "params": "callee long, pos int, name long", "returns": "callee long, value long", "dispatch": "obj long, name string, callee long", "entries": "method long",
    }
    held, edges = pointers.points_to_on_the_fly(**{n: spark.createDataFrame(tables.get(n, []), s) for n, s in schemas.items()}, k=k)
    return {(r.var, tuple(r.ctx), r.obj, tuple(r.made)) for r in held.collect()}, {(r.site, tuple(r.ctx), r.callee) for r in edges.collect()}


#: method 1: f = function 101; x = new 100; r = f(x). method 2(p): return p. The call is known only through f.
THROUGH_POINTER = {
    "statements": [(1, "address", 101, 10, None), (1, "address", 100, 11, None)],
    "calls": [(900, 1, None, 10, "()", 12)], "args": [(900, 0, 11)], "params": [(2, 0, 20)], "returns": [(2, 20)], "dispatch": [(101, "()", 2)], "entries": [(1,)],
}


@pytest.mark.parametrize("k", [0, 1, 2])
def test_calls_through_pointers_are_found_on_the_way(spark, k):
    held, edges = on_the_fly(spark, k, **THROUGH_POINTER)
    inside = (2,) if k else ()
    assert edges == {(900, (), 2)}
    assert held == {(10, (), 101, ()), (11, (), 100, ()), (20, inside, 100, ()), (12, (), 100, ())}


@pytest.mark.parametrize("k", [0, 1, 2])
def test_contexts_keep_callers_apart(spark, k):
    """1 calls 2 and 3, which both call 4(p) { return p }, each with an object of its own."""
    tables = {
        "statements": [(2, "address", 200, 20, None), (3, "address", 300, 30, None)],
        "calls": [(1, 1, 2, None, None, None), (2, 1, 3, None, None, None), (3, 2, 4, None, None, 21), (4, 3, 4, None, None, 31)],
        "args": [(3, 0, 20), (4, 0, 30)], "params": [(4, 0, 40)], "returns": [(4, 40)], "entries": [(1,)],
    }
    held, _ = on_the_fly(spark, k, **tables)
    mixed = k < 2  # one callee back, both calls of 4 look the same
    assert {o for v, _, o, _ in held if v == 21} == ({200, 300} if mixed else {200})
    assert {o for v, _, o, _ in held if v == 31} == ({200, 300} if mixed else {300})


def test_fields_of_objects_by_context_and_receivers(spark):
    """3() { o = new 300; return o }, called by 1 and 2, which put 100 and 200 into its field 7; then 1 calls o.m()."""
    tables = {
        "statements": [(3, "address", 300, 30, None), (1, "address", 100, 10, None), (2, "address", 200, 20, None), (1, "write", 10, 11, 7), (2, "write", 20, 21, 7), (1, "load", 11, 12, 7), (2, "load", 21, 22, 7)],
        "calls": [(1, 1, 3, None, None, 11), (2, 2, 3, None, None, 21), (3, 1, None, 11, "m", None)], "returns": [(3, 30)], "params": [(4, -1, 40)], "dispatch": [(300, "m", 4), (300, "n", 5)], "entries": [(1,), (2,)],
    }
    held, edges = on_the_fly(spark, 2, **tables)
    assert {o for v, _, o, _ in held if v == 12} == {100, 200}  # entries have no context: both made under [3]
    assert (3, (), 4) in edges and not any(callee == 5 for *_, callee in edges)
    assert {(c, o) for v, c, o, _ in held if v == 40} == {((4,), 300)}


def program(spark, statements, after, calls=(), args=(), params=(), exits=(), entries=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return tracking.Program(
        make(statements, "node long, def_base string, def_field string, use_base string, use_field string"), make(after, "node long, to long"), make(calls, "node long, callee long"), make(args, "node long, pos int, value string"),
        make(params, "callee long, pos int, name string"), make(exits, "callee long, node long, value string"), make([(e,) for e in entries], "node long"),
    )


def two_callers(spark):
    """1: a = source(); 2: b = id(a); 3: sink(b) and 11: c = clean; 12: d = id(c); 13: sink(d); 50: id(p) { return p }."""
    statements = [(1, "a", "", None, ""), (2, "b", "", "a", ""), (3, None, "", "b", ""), (11, "c", "", None, ""), (12, "d", "", "c", ""), (13, None, "", "d", ""), (50, None, "", "p", ""), (51, None, "", "p", "")]
    return program(spark, statements, [(1, 2), (2, 3), (11, 12), (12, 13), (50, 51)], [(2, 50), (12, 50)], [(2, 0, "a"), (12, 0, "c")], [(50, 0, "p")], [(50, 51, "p")], [1, 11])


def test_taint_crosses_methods_and_returns_to_its_own_caller(spark):
    sources = spark.createDataFrame([(1, "a", "")], "node long, base string, field string")
    sinks = spark.createDataFrame([(3, "b"), (13, "d"), (51, "p")], "node long, base string")
    assert pairs(tracking.taint_flows(two_callers(spark), sources, sinks)) == {(1, 3, "b", ""), (1, 51, "p", "")}


def test_taint_from_a_source_within_a_callee_and_through_fields(spark):
    """1: o.f = secret() via 50(q) { q.f = source() }; 2: x = o.f; 3: o.f = clean; 4: sink(o), 5: sink(x)."""
    statements = [(1, None, "", "o", ""), (2, "x", "", "o", "f"), (3, "o", "f", None, ""), (4, None, "", "o", ""), (5, None, "", "x", ""), (50, "q", "f", None, ""), (51, None, "", "q", "")]
    them = program(spark, statements, [(1, 2), (2, 3), (3, 4), (4, 5), (50, 51)], [(1, 50)], [(1, 0, "o")], [(50, 0, "q")], [(50, 51, None)], [1])
    sources = spark.createDataFrame([(50, "q", "f")], "node long, base string, field string")
    sinks = spark.createDataFrame([(2, "o"), (4, "o"), (5, "x")], "node long, base string")
    assert pairs(tracking.taint_flows(them, sources, sinks)) == {(50, 2, "o", "f"), (50, 5, "x", "")}


def test_undefined_bases_and_fields(spark):
    """1: o = new C, o.f not set; 2: t = o.f; 3: r = t.g; 4: o.f = v; 5: u = o.f; 6: s = u.g."""
    statements = [(1, "o", "", None, ""), (2, "t", "", "o", "f"), (3, "r", "", "t", "g"), (4, "o", "f", "v", ""), (5, "u", "", "o", "f"), (6, "s", "", "u", "g")]
    them = program(spark, statements, [(k, k + 1) for k in range(1, 6)], entries=[1])
    missing = spark.createDataFrame([(1, "o", "f")], "node long, base string, field string")
    assert pairs(tracking.undefined_uses(them, missing)) == {(3, "t", "g", 1)}


def test_a_long_procedure_takes_no_more_rounds_than_a_short_one(spark, monkeypatch):
    """1: a = source(); then 30 statements; 31: sink(a)."""
    from codequarry.operators.flow import PATH
    from codequarry.plans.fixpoint import Dealt

    rounds, add = [], Dealt.add
    monkeypatch.setattr(Dealt, "add", lambda self, rows, k=0: (rounds.append(k) if self.by == PATH else None) or add(self, rows, k))
    them = program(spark, [(1, "a", "", None, "")] + [(k, None, "", "b", "") for k in range(2, 31)] + [(31, None, "", "a", "")], [(k, k + 1) for k in range(1, 31)], entries=[1])
    them.procedures = spark.range(1, 32).selectExpr("1L as start", "id as node")
    sources = spark.createDataFrame([(1, "a", "")], "node long, base string, field string")
    sinks = spark.createDataFrame([(31, "a")], "node long, base string")
    assert pairs(tracking.taint_flows(them, sources, sinks)) == {(1, 31, "a", "")}
    assert max(rounds) <= 2


def test_signatures_name_methods_by_file_namespace_class_and_parameters(spark):
    methods = spark.createDataFrame([("m1", "f", None, "_default", "run", ["x:number"]), ("m2", "f", "n", "C", "run", []), ("m3", "f", "n", "C", "run", ["x:number"]), ("m4", "g", None, "C", "run", [])], "method string, file string, namespace string, class string, name string, params array<string>")
    rows = [("f", "_", "_", "run", ["x:number"], "a"), ("f", "n", "C", "run", ["x:number"], "b"), ("f", "n", "C", "run", None, "c"), ("f", "_", "C", "run", None, "d"), ("g", "_", "C", "run", ["x:number"], "e"), ("g", "_", "C", "run", [], "f")]
    spec = spark.createDataFrame(rows, "file string, namespace string, class string, name string, params array<string>, role string")
    assert pairs(joins.match_signatures(spec, methods).select("role", "method")) == {("a", "m1"), ("b", "m3"), ("c", "m2"), ("f", "m4")}


def joined_rows(df):
    """Rows that the joins of df's plan gave, df once collected."""

    def of(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return of(node.executedPlan())
        if name.endswith("QueryStage"):
            return of(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0
        kids = node.children()
        return own + sum(of(kids.apply(k)) for k in range(kids.size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_signatures_of_one_name_meet_without_pairs(spark):
    n = 300
    methods = spark.createDataFrame([(f"m{k}", "f", None, "c", "go", [f"x:{k % 3}"]) for k in range(n)], "method string, file string, namespace string, class string, name string, params array<string>")
    spec = spark.createDataFrame([("f", "_", "c", "go", [f"x:{k % 4}"] if k % 2 else None, f"r{k}") for k in range(n)], "file string, namespace string, class string, name string, params array<string>, role string")
    got = joins.match_signatures(spec, methods)
    want = {f"r{k}": f"m{k % 4 if k % 2 else 0}" for k in range(n) if k % 4 < 3}
    assert {r["role"]: r["method"] for r in got.collect()} == want
    assert joined_rows(got) == len(want)


CODE = """struct A {
  @State n: number = 0;
  build() {
    Column() {
      Text(this.n)
    }
  }
  other() {
    return 1;
  }
}"""


def test_a_round_puts_answers_back_into_files(spark, tmp_path):
    def replace_text():
        """Puts Row for Column; leaves a bracket open at the first attempt for files that say so; never answers on Lost."""

        def reply(prompt):
            code = prompt.split("Code:\n")[-1]
            if "Lost" in code:
                raise TimeoutError("no answer")
            if "Slow" in code and not prompt.startswith("Attempt 2"):
                return "```ets\n" + code + " {\n```"
            if "Parts" in code:
                code += "\n// ...\nmore"
            return "```ets\n" + code.replace("Column", "Row") + "\n```"

        return reply

    def lengths():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    names = {"a": CODE, "slow": CODE.replace("Text", "Slow"), "lost": CODE.replace("Text", "Lost"), "parts": CODE.replace("Text", "Parts"), "clean": CODE}
    files = spark.createDataFrame(list(names.items()), "path string, content string")
    findings = spark.createDataFrame([(p, 5, "r1") for p in names if p != "clean"] + [("a", 9, "r2"), ("a", 2, "r9"), ("clean", 2, "r9")], "path string, line int, rule string")
    meta = spark.createDataFrame([("r1", False), ("r2", False), ("r9", True)], "rule string, needs_context boolean")
    examples = spark.createDataFrame([(1, "r1", "bad", "slow", "good"), (2, "r1", "bad2", "x", "good2"), (3, "r2", "b", "c", "d")], "id long, rule string, problem string, note string, fix string")
    vectors = spark.createDataFrame([(1, "r1", [1.0, 0.0]), (2, "r1", [0.0, 1.0]), (3, "r2", [1.0, 1.0])], "id long, rule string, vec array<double>")
    tables = (findings, meta, examples, vectors, replace_text, lengths)
    out = rounds.repair_round(spark, str(tmp_path), 1, files.where("path <> 'clean'"), *tables)
    got = {r.path: r for r in out.collect()}
    assert {p: (r.status, r.attempt) for p, r in got.items()} == {"a": ("fixed", 1), "slow": ("fixed", 2), "lost": ("failed", None), "parts": ("failed", None)}
    assert got["a"].content == CODE.replace("Column", "Row") and got["lost"].content == names["lost"]
    assert got["slow"].content == names["slow"].replace("Column", "Row")
    again = {r.path: r for r in rounds.repair_round(spark, str(tmp_path), 1, files.withColumn("content", F.concat("content", F.lit("!"))), *tables).collect()}
    assert again["clean"].content == CODE + "!" and again["clean"].status == "unchanged"  # rule r9 has no example
    assert {p: r for p, r in again.items() if p != "clean"} == got  # finished files aren't done again


def test_splice_equals_a_fold_of_the_patches(spark):
    rng = random.Random(4)
    text_of = {f"f{k}": [f"line {k}.{j}" for j in range(30)] for k in range(6)}
    patches = []
    for path in text_of:
        at = 1
        while (start := at + rng.randint(0, 5)) <= 26:
            end = start + rng.randint(0, 3)
            patches.append((path, start, end, "\n".join(f"new {start}.{j}" for j in range(rng.randint(1, 4)))))
            at = end + 1 + rng.randint(0, 2)
    lines = spark.createDataFrame([(p, j + 1, t) for p, ts in text_of.items() for j, t in enumerate(ts)], "path string, line_no int, text string")
    got = {}
    for r in rounds.splice(lines, spark.createDataFrame(patches, "path string, start int, end int, text string")).orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append(r.text)
    for path, start, end, new in sorted(patches, reverse=True):
        text_of[path][start - 1 : end] = new.split("\n")
    assert got == text_of


def test_bucketed_retrieval_finds_most_and_with_all_probes_everything(spark):
    rng = random.Random(3)
    rows = [(i, f"r{i % 2}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "id long, rule string, vec array<double>")
    queries = vectors.where("id % 8 = 0").selectExpr("id AS qid", "rule", "vec AS qvec")
    planes = retrieve.Hyperplanes(16)
    index, exact = planes.index(vectors), retrieve.top_k_examples(queries, vectors, 5)
    assert pairs(retrieve.top_k_approximate(queries, index, planes, 5, near=planes.bits)) == pairs(exact)
    shares = [r["recall"] for r in retrieve.recall(retrieve.top_k_approximate(queries, index, planes, 5), exact).collect()]
    assert len(shares) == 50 and sum(shares) / 50 >= 0.9


def test_strong_components_of_long_chains_and_rings(spark):
    """A chain of 3,000 nodes, a ring of 1,000, and a ring of 600 with a tail and a chord."""
    edges = [(k, k + 1) for k in range(3000)] + [(k, 5000 + (k + 1) % 1000) for k in range(5000, 6000)] + [(k, 7000 + (k + 1) % 600) for k in range(7000, 7600)]
    edges += [(7599, 8000), (8000, 8001), (7100, 7300), (2999, 9000), (9000, 2000)]
    rows = spark.createDataFrame([(s if s < 5000 or s >= 6000 else s, d if not 5000 <= s < 6000 else 5000 + (s - 5000 + 1) % 1000) for s, d in edges], "src long, dst long")
    nodes = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
    got = {r.id: (r.scc, r.in_cycle) for r in graph.strong_components(nodes, rows).collect()}
    want = {k: (k, False) for k in range(3001)} | {8000: (8000, False), 8001: (8001, False)}
    want |= {k: (5000, True) for k in range(5000, 6000)} | {k: (7000, True) for k in range(7000, 7600)}
    want |= {k: (2000, True) for k in [*range(2000, 3000), 9000]}
    assert got == want


def kept_rows(monkeypatch, *modules):
    """Numbers of rows of the tables that these modules store."""
    sizes = []

    def counted(keep):
        def run(df, *label):
            out = keep(df, *label)
            sizes.append(out.count())
            return out

        return run

    for m in modules:
        monkeypatch.setattr(m, "stored", counted(m.stored))
    return sizes


def test_calls_store_no_pairs_of_sites_and_callees(spark, monkeypatch):
    names = [f"c{k}" for k in range(60)]
    classes = spark.createDataFrame([("top", True), ("main", False)] + [(c, False) for c in names], "class string, abstract boolean")
    extends = spark.createDataFrame([(c, "top") for c in names], "child string, parent string")
    methods = spark.createDataFrame([(c, "run", False) for c in names], "class string, name string, abstract boolean")
    sites = spark.createDataFrame([(k, "main" if k < 2 else f"c{k % 80}", "top", "run") for k in range(200)] + [(900, None, "top", None)], "site int, caller string, declared string, name string")
    entries = spark.createDataFrame([("main",)], "class string")
    creates = spark.createDataFrame([("main", "c1"), ("c1", "c2"), ("c2", "c3"), ("c70", "c4"), ("main", None)], "caller string, class string")
    subs = calls.subclasses(extends, classes)
    found = calls.targets(sites, subs, classes, methods)
    want = pairs(calls.calls_by_hierarchy(found, entries).select("site", "caller", "callee")), pairs(calls.calls_by_instantiation(found, creates.dropna(), entries))
    sizes = kept_rows(monkeypatch, calls)
    table = calls.dispatch(subs, classes, methods)
    got = pairs(calls.reached_calls(sites, table, entries)), pairs(calls.reached_calls(sites, table, entries, creates))
    assert got == want and len(got[0]) > 5000 and {c for _, _, c in got[1]} == {"c1", "c2", "c3"}
    assert sizes and max(sizes) <= 200


def test_roots_share_what_the_hub_and_components_reach(spark, monkeypatch):
    ring = [(k, (k + 1) % 14) for k in range(14)]
    edges = spark.createDataFrame([*ring, *[(0, 5), (0, 9), (12, 0), (8, None), (100, 101), (101, 3), (101, 102), (102, 103), (7, 200), (200, 201), (103, 200), (300, 301), (301, 201), (400, 401), (None, 401)]], "src long, dst long")
    start = spark.createDataFrame([(r, r) for r in [*range(0, 14, 2), 100, 102, 200, 300, 400, 500]], "root long, node long")
    want = pairs(graph.reachable(edges, start))
    wanted = pairs(graph.reachable(edges.union(edges.select("dst", "src")), start))
    sizes = kept_rows(monkeypatch, graph)
    got = graph.reachable_past_hub(edges, start).collect()
    assert pairs_of(got) == want and len(got) == len(want)
    related = flow.related_values(edges, start.select(F.col("root").alias("id"))).collect()
    assert pairs_of(related) == wanted and len(related) == len(wanted)
    assert max(sizes) < len(want) / 2  # no table of all pairs


def pairs_of(rows):
    return {tuple(r) for r in rows}


def test_equal_ranges_stay_in_one_island(spark):
    rows = [(p, s, e) for p in range(40) for s, e in [(407, 408), (464, 467), (464, 467), (469, 470), (469, 470)]]
    got = windows.merge_ranges(spark.createDataFrame(rows, "path int, start long, end long")).select("path", "start", "end", "n").collect()
    assert sorted(map(tuple, got)) == [r for p in range(40) for r in [(p, 407, 408, 1), (p, 464, 467, 2), (p, 469, 470, 2)]]


def test_matrix_scores_leave_the_results_of_the_formula(spark, monkeypatch):
    rng = random.Random(9)
    vec = lambda: [rng.choice([-1.0, 0.25, 0.5, 1.0, 2.0]) for _ in range(4)]
    rows = [(k, k % 2, vec()) for k in range(300)] + [(7, 1, vec()), (None, 0, vec()), (400, 0, None), (401, 0, [1.0, None, 1.0, 1.0]), (402, 1, [1.0, 2.0]), (403, None, vec())]
    vectors = spark.createDataFrame(rows, "id long, rule int, vec array<double>")
    queries = vectors.where("id % 20 < 3 or id >= 400").selectExpr("id as qid", "rule", "vec as qvec")
    all_pairs = queries.join(vectors, "rule").select("qid", "id", F.round(retrieve.cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))
    place = F.row_number().over(retrieve.W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    want = sorted(map(str, all_pairs.withColumn("place", place).where("place <= 6").collect()))
    monkeypatch.setattr(retrieve, "GROUP_VECTORS", 40)
    scored = []
    keep = retrieve._leaders
    monkeypatch.setattr(retrieve, "_leaders", lambda *a: scored.append(keep(*a)) or scored[-1])
    got = retrieve.top_k_examples(queries, vectors, 6)
    assert sorted(map(str, got.collect())) == want
    assert scored[0].count() < all_pairs.count() / 2  # few pairs meet the formula


def test_contexts_go_along_long_chains_by_squared_steps(spark, monkeypatch):
    """As many rounds as doublings, with the last callees; where squared steps would grow too much, by the longest that didn't."""
    rounds = []
    fixpoint = graph.fixpoint

    def counted(seed, step, key, most=None):
        def each(d, a):
            rounds.append(1)
            return step(d, a)

        return fixpoint(seed, each, key, most)

    monkeypatch.setattr(graph, "fixpoint", counted)
    monkeypatch.setattr(graph, "HOPS", 3)
    for n, jumps in ((30, 8), (8, 0)):
        pag = spark.createDataFrame([(-1, 0, "address")] + [(i, i + 1, "copy") for i in range(n) if i % 7], "src long, dst long, kind string")
        calls = spark.createDataFrame([(i, i + 1, i + 1) for i in range(n) if not i % 7], "src long, dst long, callee long")
        monkeypatch.setattr(graph, "MOST_JUMPS", jumps)
        want = {i: [x for x in range(i, 0, -1) if x % 7 == 1][:2] for i in range(n + 1)}
        assert {r["var"]: r["ctx"] for r in flow.points_to_ctx(pag, calls, 2).collect()} == want
        if jumps:
            assert len(rounds) <= graph.HOPS


def test_undefined_uses_walk_a_method_in_one_task(spark, monkeypatch):
    """No rounds over the table: a ring, a name defined on one of two ways, a block out of reach, a name used before its own definition."""
    monkeypatch.setattr(flow, "fixpoint", None)
    stmts = spark.createDataFrame([(1, 1, "a", "a"), (1, 2, "b", "c"), (1, 3, "c", "b"), (1, 4, "x", "b"), (1, 5, "y", "b"), (1, 9, "z", "z"), (2, 1, None, "a"), (2, 2, "a", None), (3, 2, "a", "a")], "method long, block int, def string, use string")
    cfg = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4), (1, 4, 3), (1, 2, 5), (2, 1, 2)], "method long, src int, dst int")
    assert pairs(flow.undefined_uses(stmts, cfg)) == {(1, 1, "a"), (1, 2, "c"), (1, 3, "b"), (1, 4, "b"), (2, 1, "a")}


def test_equal_vectors_make_no_pairs_beyond_k(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "GROUP_VECTORS", 5)
    monkeypatch.setattr(retrieve, "GROUP_QUERIES", 4)
    vectors = spark.createDataFrame([(k, "r", [float(k % 3), 1.0] if k % 4 else None) for k in range(240)] + [(0, "r", None), (1, "r", [1.0, 1.0])], "id long, rule string, vec array<double>")
    queries = spark.createDataFrame([(f"q{k}", "r", [float(k), 1.0]) for k in range(20)], "qid string, rule string, qvec array<double>")
    leaders = retrieve._leaders(queries, vectors, ["rule"], 2)
    assert leaders.groupBy("qid").count().agg({"count": "max"}).first()[0] <= 4 * 2  # three directions and null
    got = {(r["qid"], r["place"]): r["id"] for r in retrieve.top_k_examples(queries, vectors, 2).collect()}
    assert len(got) == 40 and [got["q0", p] for p in (1, 2)] == [3, 6] and [got["q1", p] for p in (1, 2)] == [1, 1] and [got["q9", p] for p in (1, 2)] == [2, 5]


def test_versions_of_a_method_are_read_in_one_walk(spark):
    frame = lambda rows, *names: spark.createDataFrame(rows, f"method long, {', '.join(names)}")
    edges = frame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4), (1, 5, 4)], "src int", "dst int")
    blocks = frame([(1, k) for k in (1, 2, 3, 4, 5)], "block int")
    defs = frame([(1, 1, "x"), (1, 2, "x"), (1, 2, "x"), (1, 5, "x"), (1, None, "x"), (None, 1, "x"), (1, 1, None)], "block int", "name string")
    uses = frame([(1, 4, "x"), (1, 4, "x"), (1, 3, "x"), (1, 5, "x"), (1, 2, None), (1, 2, "y")], "block int", "name string")
    tree = dominance.dominator_tree(blocks, edges)
    live = edges.where("src < 5")
    phis = dominance.phi_sites(defs, dominance.dominance_frontier(blocks, edges), live)
    assert sorted(map(tuple, phis.collect())) == [(1, 4, "x")]
    found = dominance.version_variables(defs, uses, phis, tree)
    assert "Window" not in found._jdf.queryExecution().toString()
    # numbers of x: 1 no block, 2 and 3 blocks 1 and 2, 4 the merge, 5 block 5
    assert {tuple(r) for r in found.collect()} == {(1, 4, "x", 4), (1, 3, "x", 2), (1, 2, None, 1), (1, 2, "y", 0)} and found.count() == 4
    assert sorted(map(tuple, dominance.phi_arguments(defs, phis, tree, live).collect())) == [(1, 4, "x", 2, 3), (1, 4, "x", 3, 2)]


def test_imports_of_many_starts_are_bits_of_few_rows(spark, monkeypatch):
    n = 300
    links = [(k, (k + 1) % n) for k in range(n)] + [(k, (k * 7 + 3) % n) for k in range(0, n, 3)] + [(5, None), (n, 0)]
    edges = spark.createDataFrame(links, "src long, dst long")
    start = spark.createDataFrame([(k,) for k in range(n + 1)] + [(4,), (None,)], "id long")
    kept = []
    dealt_ = graph.Dealt
    monkeypatch.setattr(graph, "Dealt", lambda *a: kept.append(dealt_(*a)) or kept[-1])
    got = sorted(map(str, graph.dependency_order(edges, start).collect()))
    after, want = {}, {(None, None): 0}
    for s, d in links:
        after.setdefault(s, set()).add(d)
    for root in range(n + 1):
        now, hops = {root}, 0
        while now:
            want |= {(root, x): hops for x in now}
            now, hops = {d for x in now for d in after.get(x, ()) if (root, d) not in want}, hops + 1
    assert got == sorted(f"Row(root={a}, node={b}, hops={h})" for (a, b), h in want.items())
    assert 4 * kept[0].rows().count() < len(want)
