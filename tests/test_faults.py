"""Each rule of a check must be seen to fail: SQL counts at least one planted violation in the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.01")
RULES = [n for n in entry.oracle_sql() if n.endswith("_planted")]


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", RULES)
def test_every_rule_has_a_planted_violation(name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    out = con.execute(entry.oracle_sql()[name]).df()
    counted = out["detail"] if "detail" in out else out["mismatches"]
    assert len(out) and (counted > 0).all(), out
