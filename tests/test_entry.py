from pathlib import Path

import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["a3_conflict_winner", "a6_knowledge_fusion", "j3_comparison", "c2_bm25_lite", "o3_vector_top_k"])
def test_results_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    got = contract.queries()[name](spark, str(DATA))
    want = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert set(columns) == set(got.columns)

    def comparable(row):
        return tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)

    assert sorted(map(comparable, want.fetchall())) == sorted(map(comparable, (tuple(r[c] for c in columns) for r in got.collect())))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_query_can_be_written(spark, tmp_path):
    """Column names must be unique and every type storable."""
    failed = {}
    for name, query in contract.queries().items():
        try:
            df = query(spark, str(DATA))
            df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(str(tmp_path / name))
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error)[:200]
    assert not failed
