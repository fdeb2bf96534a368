import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import assert_same  # noqa: E402
from snapstride.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names


def test_lines_without_an_id_are_as_in_their_sql(spark):
    import duckdb

    from snapstride.llm import line_dedup, sql

    line = "A line that is well over forty code points long, it is."
    rows = [(i, f"{line}\nown {i}") for i in range(5)] + [(None, f"{line}\nx"), (None, None), (7, None)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.sha) for r in found.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS sha").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted((str(d), n, k, sha) for d, n, k, sha in con.execute(sql.LINE_DEDUP).fetchall())
