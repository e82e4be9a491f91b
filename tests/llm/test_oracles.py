"""The SQL of text queries gives their rows, on the smallest test tables and on a table of edge cases."""

import os

import duckdb
import pytest

from tessellar.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import make

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Nulls, empty and repeated texts, shared doc_ids, a text that holds two items, and a language of enough texts for a reference."""
    folder = str(tmp_path_factory.mktemp("edges"))
    rows = [r[:4] for r in make()]
    long = " ".join(f"{w} of the {k}" for k, w in enumerate(["river", "stone", "Ñandú", "north."] * 30))
    rows += [(500 + i, f"{long} {i} lines\n{long[:40]}\n\nx\nx {i * '#|'}", "xx", "s") for i in range(40)]
    rows += [(500, "of the one and the same id", "xx", "s"), (500, None, None, "s"), (600, " ".join(f"#$%&|<>{k}" for k in range(100)), "xx", "s"), (601, "q w e r t y u " * 12 + long, "xx", "s")]
    items = [(1, " ".join(long.split()[4:20])), (10, "Lines x"), (2, " ".join(long.split()[30:38])), (3, None), (4, " - ")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def by_sql(folder, sql, columns):
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = f"{folder}/{table}.parquet"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("where", ["small", "edges"])
def test_sql(spark, edges, name, where):
    folder = SMALL if where == "small" else edges
    got = QUERIES[name](spark, folder)
    key = lambda row: [(x is None, str(x)) for x in row]
    want = by_sql(folder, ORACLE_SQL[name], got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(want, key=key)
    if where == "edges" and name.startswith("op2"):
        assert any(r[got.columns.index("contaminated")] for r in rows)
    if where == "edges" and name.startswith("op7"):
        kept, failed, far = (got.columns.index(c) for c in ("kept", "base_failed", "word_distance"))
        assert any(not r[kept] and not r[failed] for r in rows) and any(r[far] is not None for r in rows)
