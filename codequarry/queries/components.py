"""Queries of the declaration operators, over code wrapped as components."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import declarations as D
from codequarry.plans import standins as X
from codequarry.plans.standins import sql

QUERIES: dict = {}
ORACLES: dict = {}


def component_lines(spark, sf):
    """Each order is a component whose build holds a declaration, its use, and a callback."""
    o = X.table(spark, sf, "orders")
    k, v = F.col("o_orderkey").cast("string"), F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string"))
    place = F.col("o_orderkey") % 4
    texts = F.array(
        F.when(place == 3, "@Stat").otherwise("@Component"),
        F.concat(F.lit("struct S"), k, F.lit(" {")),
        F.when(place == 1, F.concat(F.lit("  let "), v, F.lit(" = 1;"))).otherwise(F.lit("  @State n: number = 0;")),
        F.lit("  build() {"),
        F.when(place == 2, F.concat(F.lit("    const "), v, F.lit(" = 2;"))).otherwise(F.lit("")),
        F.lit("    Column() {"),
        F.concat(F.lit("      Text("), v, F.lit(")")),
        F.lit("      .onClick(() => {"),
        F.lit("        let own = 3;"),
        F.lit("      })"),
        F.lit("    }"),
        F.lit("  }"),
        F.lit("}"),
    )
    return o.select(F.col("o_orderkey").alias("path"), F.posexplode(texts).alias("p", "text")).select("path", (F.col("p") + 1).alias("line_no"), "text")


def p18_declaration_report(spark, sf):
    return D.declaration_report(component_lines(spark, sf))


def p19_hoist_declarations(spark, sf):
    return D.hoist_declarations(component_lines(spark, sf))


#: The lines, their scopes by braces, and the report, as SQL over the lines alone.
PARSED = r"""t AS (SELECT o_orderkey AS path, o_orderkey % 4 AS k, 'v' || CAST(o_orderkey % 7 AS VARCHAR) AS v FROM orders),
u AS (SELECT path, [CASE WHEN k = 3 THEN '@Stat' ELSE '@Component' END, 'struct S' || CAST(path AS VARCHAR) || ' {', CASE WHEN k = 1 THEN '  let ' || v || ' = 1;' ELSE '  @State n: number = 0;' END, '  build() {',
    CASE WHEN k = 2 THEN '    const ' || v || ' = 2;' ELSE '' END, '    Column() {', '      Text(' || v || ')', '      .onClick(() => {', '        let own = 3;', '      })', '    }', '  }', '}'] AS texts FROM t),
c AS (SELECT path, CAST(i AS INTEGER) AS line_no, texts[i] AS text FROM u, range(1, 14) r(i)),
b AS (SELECT *, sum(length(replace(text, '}', '')) - length(replace(text, '{', ''))) OVER (PARTITION BY path ORDER BY line_no) AS cum, max(line_no) OVER (PARTITION BY path) AS last FROM c),
heads AS (SELECT path, line_no AS head, cum, last, CASE WHEN regexp_matches(text, '^\s*(export\s+)?struct\s+\w+.*\{\s*$') THEN 'component' WHEN regexp_matches(text, '^\s*build\s*\(\s*\)\s*\{\s*$') THEN 'build' WHEN regexp_matches(text, '=>\s*\{\s*$') THEN 'arrow'
    WHEN regexp_matches(text, '^\s*(if|for|while|switch|[A-Z]\w*)\s*\(') THEN 'block' WHEN regexp_matches(text, '^\s*(async\s+|private\s+)?\w+\s*\([^)]*\)\s*(:\s*\w+\s*)?\{\s*$') THEN 'function' ELSE 'block' END AS kind FROM b WHERE regexp_matches(text, '\{\s*$')),
scopes AS (SELECT h.path, h.head, h.kind, coalesce(min(e.line_no), any_value(h.last)) AS stop FROM heads h LEFT JOIN b e ON e.path = h.path AND e.line_no > h.head AND trim(e.text) <> '' AND e.cum = h.cum - 1 GROUP BY ALL),
noted AS (SELECT c.path, c.line_no, c.text, max_by(s.kind, s.head) AS scope FROM c LEFT JOIN scopes s ON s.path = c.path AND s.kind <> 'block' AND c.line_no > s.head AND c.line_no <= s.stop WHERE regexp_matches(c.text, '^\s*(let|const)\s+\w+|^\s*@\w+') GROUP BY ALL),
report AS (SELECT path, line_no, text, CASE WHEN regexp_matches(text, '^\s*(let|const)\s+\w+') AND scope = 'component' THEN 'declared in component' WHEN regexp_matches(text, '^\s*(let|const)\s+\w+') AND scope = 'build' THEN 'declared in build'
    WHEN regexp_extract(text, '^\s*@(\w+)', 1) NOT IN ('', """ + ", ".join(f"'{d}'" for d in D.DECORATORS) + r""") THEN 'unknown decorator' END AS problem FROM noted)"""
#: Names moved from earlier lines are read as this.name, unless a colon follows; then moved lines go below their component's head.
HOISTED = r""", moved AS (SELECT r.path, r.line_no, max(s.head) AS c, regexp_replace(r.text, '^(\s*)(?:let|const)\s+', '\1') AS text FROM report r JOIN scopes s ON s.path = r.path AND s.kind = 'component' AND r.line_no > s.head AND r.line_no <= s.stop WHERE problem = 'declared in build' GROUP BY ALL),
names AS (SELECT c.path, c.line_no, string_agg(DISTINCT regexp_extract(m.text, '^\s*(\w+)', 1), '|') AS names FROM c JOIN moved m ON m.path = c.path AND m.line_no < c.line_no GROUP BY ALL),
placed AS (SELECT c.path, coalesce(m.c, c.line_no) AS a, CASE WHEN m.c IS NULL THEN 0 ELSE c.line_no END AS z, coalesce(m.text, CASE WHEN n.names IS NULL THEN c.text ELSE regexp_replace(c.text, '(^|[^\w.])(' || n.names || ')(\s*[^\s:\w]|\s*$|\s+\w)', '\1this.\2\3', 'g') END) AS text
    FROM c LEFT JOIN moved m ON m.path = c.path AND m.line_no = c.line_no LEFT JOIN names n ON n.path = c.path AND n.line_no = c.line_no),
kept AS (SELECT *, trim(text) = '' AND coalesce(trim(lag(text) OVER (PARTITION BY path ORDER BY a, z)) = '', false) AS again FROM placed)"""

QUERIES["p18_declaration_report"] = p18_declaration_report
ORACLES["p18_declaration_report"] = sql(more=PARSED, body=r"SELECT path, line_no, problem, CASE WHEN problem = 'unknown decorator' THEN regexp_replace(text, '^(\s*)@\w+\s*', '\1') ELSE regexp_replace(text, '^(\s*)(?:let|const)\s+', '\1') END AS suggestion FROM report WHERE problem IS NOT NULL")
QUERIES["p19_hoist_declarations"] = p19_hoist_declarations
ORACLES["p19_hoist_declarations"] = sql(more=PARSED + HOISTED, body="SELECT path, string_agg(text, chr(10) ORDER BY a, z) AS content FROM kept WHERE NOT again GROUP BY path")
