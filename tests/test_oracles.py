"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from codequarry.queries import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLES:
        assert rows and len(set(columns)) == len(columns)
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_pooled_means_of_odd_vectors(spark, tmp_path):
    """Null and short vectors, null components, halves that doubles miss, negative and very large ids."""
    rows = [(0, [1.0] * 64), (1, None), (2, [0.5, None] + [1.000005] * 62), (8, None), (16, [0.28575, 1.005] + [0.000125] * 10), (24, [None] * 64), (-3, [-0.000015] * 64), (-20, [2.0] * 64), ((1 << 60) + 7, [1e300] * 64), (32, [0.000015] * 64), (33, [0.000025] * 64), (None, [3.0] * 64)]
    rows += [(40 + 8 * k, [(k * 64 + i) / 200000 for i in range(64)]) for k in range(40)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["c12_pool_embedding"](spark, str(tmp_path)).select("doc", "vec").collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in con.sql(ORACLES["c12_pool_embedding"]).fetchall())
