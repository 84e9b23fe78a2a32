import duckdb
import pytest

from hearth.llm.source_mix import comparison_sql, mix_sources


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "'x' AS digest")
    return sorted((tuple(r) for r in mix_sources(docs).collect()), key=str)


def sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(comparison_sql()).fetchall(), key=str)


ROWS = [(k, "w " * (k % 17), ["b", "a", None, "Z", "é"][k % 5]) for k in range(200)]
CASES = {
    "sources": ROWS,
    "one source": [(k, "w " * k, "a") for k in range(9)],
    "hot source": ROWS + [(1000 + k, "v v v", "a") for k in range(150)],
    "no words": [(1, "", "a"), (2, None, "b"), (None, " \t", None)],
    "repeated rows": [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", "t"), (None, "a b", "t"), (2, "x", "t")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_against_sql(spark, case):
    assert run(spark, CASES[case]) == sql(CASES[case])


def test_targets(spark):
    found = run(spark, ROWS)
    total = sum(r[1] for r in found)
    sources = {r[2:4] for r in found}
    assert sum(t for _, t in sources) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for s, t in sources)
    for size, target in sources:
        taken = sum(r[4] for r in found if r[2:4] == (size, target))
        assert abs(taken - target) <= 2 * 16
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in found)
    assert sum(r[4] for r in found) <= 1.5 * total and run(spark, list(reversed(ROWS))) == found
