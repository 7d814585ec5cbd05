"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import text as T
from codequarry.plans import standins as X
from codequarry.plans.standins import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) under name, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


LINES = "SELECT path, unnest(string_split(content, chr(10))) AS text, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line_no FROM "


@query("p1_explode_lines", sql("x_docs", body=LINES + "x_docs"))
def p1(spark, sf):
    return T.explode_lines(X.x_docs(spark, sf))


@query("p2_curate", sql("x_docs", body="SELECT path, doc_id FROM x_docs WHERE NOT ends_with(path, '.test.ets') AND content <> ''"))
def p2(spark, sf):
    return T.curate(X.x_docs(spark, sf)).select("path", "doc_id")


def rule_pages(spark, sf):
    d = X.x_docs(spark, sf)
    head = F.concat(F.lit("// "), F.col("source"), F.lit("\n  //use with care\n"))
    return d.select(F.col("doc_id").alias("stem"), F.when(F.col("doc_id") % 5 == 0, F.col("content")).otherwise(F.concat(head, F.col("content"))).alias("content"))


PAGES = "pages_ AS (SELECT doc_id AS stem, CASE WHEN doc_id % 5 = 0 THEN content ELSE '// ' || source || chr(10) || '  //use with care' || chr(10) || content END AS content FROM x_docs)"


@query(
    "p3_parse_rule_pages",
    sql(
        "x_docs",
        more=PAGES + ", l AS (SELECT stem, unnest(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' '))) AS t, unnest(range(len(string_split(content, chr(10))))) AS k FROM pages_), f AS (SELECT stem, coalesce(min(k) FILTER (NOT starts_with(t, '//')), max(k) + 1) AS first FROM l GROUP BY stem)",
        body="SELECT stem, coalesce(string_agg(trim(substr(t, 3), ' '), ' ' ORDER BY k) FILTER (k < first), '') AS description, coalesce(string_agg(t, ' ' ORDER BY k) FILTER (k >= first), '') AS example FROM l JOIN f USING (stem) GROUP BY stem",
    ),
)
def p3(spark, sf):
    return T.parse_rule_pages(rule_pages(spark, sf))


@query("p4_flatten_example", sql("x_docs", body="SELECT path, array_to_string(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), ' ') AS example FROM x_docs"))
def p4(spark, sf):
    return X.x_docs(spark, sf).select("path", T.flatten_example(F.col("content")).alias("example"))


@query("p5_rule_key", sql("x_docs", body=r"SELECT path, '@performance/' || regexp_extract(path, '([^/\\]+)\.[^./\\]+$', 1) AS rule FROM x_docs"))
def p5(spark, sf):
    return X.x_docs(spark, sf).select("path", T.rule_key(F.col("path")).alias("rule"))


PROJECT = r"CASE WHEN round = 0 THEN nullif(regexp_extract(replace(path, '\', '/'), '(?:^|/)origin/([^/]+)/', 1), '') ELSE nullif(regexp_extract(replace(path, '\', '/'), '(?:^|/)round_[0-9]+(?:_reject)?/([^/]+)/', 1), '') END"


@query("p6_project_of", sql("x_findings", body=f"SELECT event_id, {PROJECT} AS project FROM x_findings"))
def p6(spark, sf):
    return X.x_findings(spark, sf).select("event_id", T.project_of(F.col("path"), F.col("round")).alias("project"))


@query("p7_relative_from", sql("x_findings", body=r"SELECT event_id, substr(replace(path, '\', '/'), strpos(replace(path, '\', '/'), '/ets/') + 1) AS relative FROM x_findings WHERE strpos(replace(path, '\', '/'), '/ets/') > 0"))
def p7(spark, sf):
    return T.relative_from(X.x_findings(spark, sf)).select("event_id", "relative")


@query(
    "p8_line_snippet",
    sql("x_code_findings", "x_code", body="SELECT f.path, f.line, f.rule, coalesce(trim(c.text, ' '), '') AS snippet FROM (SELECT path, line + (line % 3) * 40 AS line, rule FROM x_code_findings) f LEFT JOIN x_code c ON c.path = f.path AND c.line_no = f.line"),
)
def p8(spark, sf):
    f = X.x_code_findings(spark, sf).withColumn("line", F.col("line") + F.col("line") % 3 * 40)
    return T.line_snippet(f, X.x_code(spark, sf)).select("path", "line", "rule", "snippet")


@query(
    "p9_statement_snippet",
    sql(
        "x_code_findings",
        "x_code",
        more=r"t AS (SELECT path, line_no, trim(text, ' ') AS t, regexp_matches(trim(text, ' '), '[{;)""'']$') OR starts_with(trim(text, ' '), '@') OR starts_with(trim(text, ' '), 'private') AS e FROM x_code), s AS (SELECT *, min(CASE WHEN e THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM t)",
        body="SELECT f.path, f.line, f.rule, string_agg(b.t, '' ORDER BY b.line_no) AS snippet FROM x_code_findings f JOIN s a ON a.path = f.path AND a.line_no = f.line JOIN s b ON b.path = f.path AND b.line_no >= f.line AND b.line_no <= coalesce(a.stop, 1000000000) GROUP BY ALL",
    ),
)
def p9(spark, sf):
    return T.statement_snippet(X.x_code_findings(spark, sf), X.x_code(spark, sf))


@query(
    "p10_identifiers_at",
    sql(
        "x_code",
        more=r"i AS (SELECT *, list_concat(regexp_extract_all(text, '@\w+\s+(\w+)', 1), regexp_extract_all(text, 'let\s+(\w+)\s*=', 1)) AS d, regexp_extract_all(text, 'this\.(\w+)', 1) AS u FROM x_code)",
        body="SELECT path, line_no, unnest(CASE WHEN len(d) > 0 THEN d ELSE u END) AS name FROM i",
    ),
)
def p10(spark, sf):
    return X.x_code(spark, sf).select("path", "line_no", F.explode(T.identifiers_at(F.col("text"))).alias("name"))


@query(
    "p11_fenced_json",
    sql(
        "x_replies",
        more=r"p AS (SELECT key, CASE WHEN json_valid(text) THEN text WHEN contains(text, '```json') THEN trim(regexp_replace(regexp_extract(text, '```json\s*([\s\S]*?)```', 1), '^\n+|\n+$', '', 'g'), ' ') END AS payload FROM x_replies)",
        body="SELECT key, payload, coalesce(json_valid(payload), false) AS valid, CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.k') AS BIGINT) END AS k FROM p",
    ),
)
def p11(spark, sf):
    rows = T.fenced_json(X.x_replies(spark, sf))
    return rows.select("key", "payload", "valid", F.try_variant_get("value", "$.k", "long").alias("k"))


PAIR_TEXT = """CASE WHEN event_id % 4 = 0 THEN 'none' ELSE 'x' || chr(10) || '```json' || chr(10) || '{"problem_code": "a' || CAST(event_id AS VARCHAR) || '", "problem_fix": ' || CASE WHEN event_id % 4 = 1 THEN '' ELSE '"b"' END || '}' || chr(10) || CASE WHEN event_id % 4 = 2 THEN '' ELSE '```' END END"""


@query(
    "p12_fix_pair",
    f"""WITH t AS (SELECT event_id AS key, {PAIR_TEXT} AS text FROM events), b AS (SELECT key, regexp_extract(text, '```json\\s*([\\s\\S]*?)(?:```|\\z)', 1) AS j FROM t)
    SELECT key, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.problem_code') END AS problem_code, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.problem_fix') END AS problem_fix FROM b""",
)
def p12(spark, sf):
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, "none").otherwise(F.concat(F.lit('x\n```json\n{"problem_code": "a'), i, F.lit('", "problem_fix": '), F.when(k == 1, "").otherwise('"b"'), F.lit("}\n"), F.when(k == 2, "").otherwise("```")))
    rows = T.fix_pair(X.table(spark, sf, "events").select(F.col("event_id").alias("key"), text.alias("text")))
    whole = F.col("problem_fix").isNotNull()  # a record that doesn't parse gives neither part
    return rows.select("key", F.when(whole, F.col("problem_code")).alias("problem_code"), "problem_fix")


@query("p13_code_block", sql("x_replies", body=r"SELECT key, coalesce(nullif(regexp_extract(text, '```(?:typescript|javascript|arkts|ets|ts|js)\n([\s\S]*)```', 1), ''), text) AS code FROM x_replies"))
def p13(spark, sf):
    return X.x_replies(spark, sf).select("key", T.code_block(F.col("text")).alias("code"))


@query("p14_all_code_blocks", sql("x_replies", more=r"b AS (SELECT key, text, regexp_extract_all(text, '```\w*\n([\s\S]*?)```', 1) AS f FROM x_replies)", body="SELECT key, CASE WHEN len(f) > 0 THEN array_to_string(f, chr(10)) ELSE text END AS code FROM b"))
def p14(spark, sf):
    return X.x_replies(spark, sf).select("key", T.all_code_blocks(F.col("text")).alias("code"))


@query("p15_apply_diff_markers", sql("x_replies", body="SELECT key, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '-')), lambda x: CASE WHEN starts_with(x, '+') THEN substr(x, 2) ELSE x END), chr(10)) AS code FROM x_replies"))
def p15(spark, sf):
    return X.x_replies(spark, sf).select("key", T.apply_diff_markers(F.col("text")).alias("code"))


@query(
    "p16_line_diff",
    sql(
        "x_pairs",
        more="a AS (SELECT key, text, count(*) AS na FROM (SELECT key, unnest(string_split(problem, chr(10))) AS text FROM x_pairs) WHERE trim(text, ' ') <> '' GROUP BY ALL), b AS (SELECT key, text, count(*) AS nb FROM (SELECT key, unnest(string_split(repair, chr(10))) AS text FROM x_pairs) WHERE trim(text, ' ') <> '' GROUP BY ALL)",
        body="SELECT key, CASE WHEN coalesce(nb, 0) > coalesce(na, 0) THEN '+' ELSE '-' END AS mark, text, abs(coalesce(nb, 0) - coalesce(na, 0)) AS times FROM a FULL JOIN b USING (key, text) WHERE coalesce(na, 0) <> coalesce(nb, 0)",
    ),
)
def p16(spark, sf):
    return T.line_diff(X.x_pairs(spark, sf), "problem", "repair")


@query("p16_line_diff_text")
def p16_text(spark, sf):
    return T.line_diff_text(X.x_pairs(spark, sf), "problem", "repair")


@query(
    "p17_bracket_report",
    sql(
        "x_code",
        more=r"""b AS (SELECT path, line_no, unnest(bs) AS bracket, CAST(unnest(range(len(bs))) AS INTEGER) AS k FROM (SELECT path, line_no, regexp_extract_all(text, '[(){}\[\]]') AS bs FROM x_code)),
        c AS (SELECT *, bracket IN ('(', '{', '[') AS o, sum(CASE WHEN bracket IN ('(', '{', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line_no, k) AS cum FROM b),
        d AS (SELECT *, least(0, min(cum) OVER (PARTITION BY path ORDER BY line_no, k)) AS fl FROM c),
        e AS (SELECT *, fl < coalesce(lag(fl) OVER (PARTITION BY path ORDER BY line_no, k), 0) AS extra FROM d),
        g AS (SELECT *, CASE WHEN extra THEN -1 ELSE cum - fl + CASE WHEN o THEN 0 ELSE 1 END END AS level FROM e),
        h AS (SELECT *, lag(bracket) OVER w AS partner, lead(bracket) OVER w AS following FROM g WINDOW w AS (PARTITION BY path, level ORDER BY line_no, k))""",
        body="""SELECT path, line_no, k, bracket, CASE WHEN extra THEN 'extra' WHEN o THEN 'unclosed' ELSE 'mismatched' END AS problem FROM h
        WHERE extra OR o AND following IS NULL OR NOT o AND CASE partner WHEN '(' THEN ')' WHEN '{' THEN '}' WHEN '[' THEN ']' END <> bracket""",
    ),
)
def p17(spark, sf):
    return T.bracket_report(X.x_code(spark, sf))


HEADS = "h AS (SELECT path, min(line_no) AS head FROM x_code WHERE contains(text, 'Column() {') GROUP BY path)"


def heads(lines):
    return lines.where(F.contains("text", F.lit("Column() {"))).groupBy("path").agg(F.min("line_no").alias("head"))


@query(
    "p20_remove_container",
    sql(
        "x_code",
        more=HEADS
        + r""", c AS (SELECT *, len(regexp_extract_all(text, '\{')) - len(regexp_extract_all(text, '\}')) AS d FROM x_code), m AS (SELECT c.*, head, sum(d) OVER (PARTITION BY path ORDER BY line_no) AS cum FROM c JOIN h USING (path)),
        e AS (SELECT m.path, coalesce(min(m.line_no) FILTER (m.line_no >= m.head AND m.cum <= q.cum - q.d), min(m.head)) AS stop FROM m JOIN m q ON q.path = m.path AND q.line_no = m.head GROUP BY m.path)""",
        body=r"SELECT path, string_agg(CASE WHEN line_no = head THEN '' WHEN line_no = stop THEN regexp_replace(text, '^([^}]*)\}', '\1') WHEN line_no > head AND line_no < stop AND starts_with(text, '  ') THEN substr(text, 3) ELSE text END, chr(10) ORDER BY line_no) AS content FROM m JOIN e USING (path) GROUP BY path",
    ),
)
def p20(spark, sf):
    lines = X.x_code(spark, sf)
    return T.remove_container(lines, heads(lines))


@query(
    "p21_flex_to_row_column",
    sql(
        "x_code",
        more=HEADS + ", f AS (SELECT path, line_no, head, CASE WHEN line_no = head THEN '  Flex({ direction: FlexDirection.' || CASE WHEN path % 2 = 0 THEN 'Column' ELSE 'Row' END || ' }) {' ELSE text END AS text FROM x_code JOIN h USING (path))",
        body="SELECT path, string_agg(CASE WHEN line_no = head THEN CASE WHEN path % 2 = 0 THEN '  Column() {' ELSE '  Row() {' END ELSE text END, chr(10) ORDER BY line_no) AS content FROM f GROUP BY path",
    ),
)
def p21(spark, sf):
    lines = X.x_code(spark, sf)
    at = heads(lines)
    flex = F.concat(F.lit("  Flex({ direction: FlexDirection."), F.when(F.col("path") % 2 == 0, "Column").otherwise("Row"), F.lit(" }) {"))
    rows = lines.join(at, "path").withColumn("text", F.when(F.col("line_no") == F.col("head"), flex).otherwise(F.col("text"))).drop("head")
    return T.flex_to_row_column(rows, at)


CODE_FILES = "cf AS (SELECT path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM x_code GROUP BY path)"


def code_files(spark, sf):
    from codequarry.functions.columns import ordered_text

    return X.x_code(spark, sf).groupBy("path").agg(ordered_text("line_no", "text").alias("content"))


@query(
    "p22_tokenize",
    sql(
        "x_code",
        more=CODE_FILES
        + r", t AS (SELECT path, unnest(m) AS text, unnest(range(len(m))) AS k FROM (SELECT path, regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\n|[ \t\r]+|[\s\S]') AS m FROM cf)), s AS (SELECT *, coalesce(sum(length(text)) OVER w, 0) AS start, coalesce(sum(CASE WHEN text = chr(10) THEN 1 ELSE 0 END) OVER w, 0) + 1 AS line FROM t WINDOW w AS (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        body=r"""SELECT path, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", text, CAST(line AS BIGINT) AS line FROM s WHERE regexp_matches(text, '^[^\s]')""",
    ),
)
def p22(spark, sf):
    return T.tokenize(code_files(spark, sf))


CALL = "CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'a' || CAST(o_custkey AS VARCHAR) || '.' || lower(o_orderstatus) || '.m' || CAST(o_orderkey AS VARCHAR) || '()' END"


@query(
    "p23_split_call_path",
    f"""WITH s AS (SELECT o_orderkey, {CALL} AS s FROM orders) SELECT o_orderkey, coalesce(nullif(regexp_extract(s, '^(\\w+)\\.(\\w+)\\.(\\w+)\\(\\)$', 1), ''), '') AS a, regexp_extract(s, '^(\\w+)\\.(\\w+)\\.(\\w+)\\(\\)$', 2) AS b, regexp_extract(s, '^(\\w+)\\.(\\w+)\\.(\\w+)\\(\\)$', 3) AS c,
    trim(regexp_extract('<q <' || s || '>', '<([^<>]*)\\(\\)>$', 1), ' ') AS last FROM s""",
)
def p23(spark, sf):
    o = X.table(spark, sf, "orders")
    s = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.lit("."), F.lower("o_orderstatus"), F.lit(".m"), F.col("o_orderkey").cast("string"), F.lit("()")))
    parts = T.split_call_path(s)
    out = [F.coalesce(F.try_element_at(parts, F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate("abc")]
    return o.select("o_orderkey", *out, T.last_bracket(F.concat(F.lit("<q <"), s, F.lit(">"))).alias("last"))


@query(
    "p24_guess_line_span",
    sql(
        "x_code",
        more="l AS (SELECT DISTINCT path, 'k' || CAST(path % 4 AS VARCHAR) AS label, CASE path % 4 WHEN 0 THEN 'Column' WHEN 1 THEN '@State v1' ELSE 'this.v2' END AS a, CASE path % 4 WHEN 3 THEN 'absent' ELSE '}' END AS b FROM x_code)",
        body="SELECT l.path, label, coalesce(min(CASE WHEN contains(text, a) THEN line_no END), 1) AS start_line, coalesce(max(CASE WHEN contains(text, b) THEN line_no END), 1) AS end_line FROM l LEFT JOIN x_code c ON c.path = l.path GROUP BY l.path, label",
    ),
)
def p24(spark, sf):
    lines = X.x_code(spark, sf)
    k = F.col("path") % 4
    labels = lines.select("path").distinct().select("path", F.concat(F.lit("k"), k.cast("string")).alias("label"), F.when(k == 0, "Column").when(k == 1, "@State v1").otherwise("this.v2").alias("label_first"), F.when(k == 3, "absent").otherwise("}").alias("label_last"))
    return T.guess_line_span(labels, lines)


@query("p25_has_modifier", "SELECT event_id, (event_id & 16) <> 0 AS is_static, (event_id & 1) <> 0 AS is_private FROM events")
def p25(spark, sf):
    bits = F.col("event_id")
    return X.table(spark, sf, "events").select("event_id", T.has_modifier(bits, "static").alias("is_static"), T.has_modifier(bits, "private").alias("is_private"))


@query(
    "p26_positions",
    "WITH p AS (SELECT o_orderkey, least(greatest(o_orderkey - 5, 0), 65535) AS l, least(greatest(o_custkey % 70 - 3, 0), 65535) AS c FROM orders) SELECT o_orderkey, CAST(CASE WHEN l >= 32768 THEN (l - 65536) * 65536 ELSE l * 65536 END + c AS INTEGER) AS packed, CAST(CASE WHEN l = 0 THEN -1 ELSE l END AS INTEGER) AS line, CAST(CASE WHEN c = 0 THEN -1 ELSE c END AS INTEGER) AS col FROM p",
)
def p26(spark, sf):
    rows = X.table(spark, sf, "orders").select("o_orderkey", T.pack_position(F.col("o_orderkey") - 5, F.col("o_custkey") % 70 - 3).alias("packed"))
    line, col = T.unpack_position(F.col("packed"))
    return rows.select("o_orderkey", "packed", line.alias("line"), col.alias("col"))


@query("p27_content_digest", sql("x_docs", body="SELECT path, sha256(content) AS digest FROM x_docs"))
def p27(spark, sf):
    return X.x_docs(spark, sf).select("path", T.content_digest(F.col("content")).alias("digest"))


@query("p28_filter_entry_methods", sql("x_methods", body="SELECT class, name, abstract FROM x_methods WHERE name IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 2)"))
def p28(spark, sf):
    names = X.table(spark, sf, "customer").where("c_custkey < 2").select(F.col("c_mktsegment").alias("name")).distinct()
    return T.filter_entry_methods(X.x_methods(spark, sf), names).select("class", "name", "abstract")


@query("p29_strip_temp_locals", "WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'this' WHEN 1 THEN '$temp' || CAST(event_id AS VARCHAR) ELSE event_type END AS name FROM events) SELECT * FROM l WHERE name <> 'this' AND NOT starts_with(name, '$')")
def p29(spark, sf):
    k = F.col("event_id") % 3
    name = F.when(k == 0, "this").when(k == 1, F.concat(F.lit("$temp"), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    return T.strip_temp_locals(X.table(spark, sf, "events").select("event_id", name.alias("name")))
