"""Every registered query against its DuckDB SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from bitextmill.plans import registry

from .conftest import DATA, ROOT

DIR = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cursor.fetchall())


def test_texts_are_rebuilt_row_by_row(spark, tmp_path):
    """Ids that repeat, null ids, and texts without units."""
    made = [(1, "a\nb"), (1, "c\n"), (2, None), (3, ""), (None, "d\n\n e"), (None, "f"), (4, "\n"), (5, " "), (1, "a\nb")]
    spark.createDataFrame(made, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.ORACLE_SQL["txt_rebuild"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = registry.QUERIES["txt_rebuild"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) == sorted(map(repr, made))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() >= 0


def test_entry_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
