import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60


def test_nothing_else_imports_the_corpus_package():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_works_without_the_corpus_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'features_events' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry_and_sql_agree_on_a_sample(spark):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name in ("features_events", "features_lineitem", "rules_applied", "threshold_sweep", "case_register", "customer_risk", "densest_windows"):
        got, want = e.queries()[name](spark, str(DATA)), con.sql(e.oracle_sql()[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        plain = lambda rows: sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in rows)
        assert plain(map(tuple, got.select(*cols).collect())) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), name


def test_corpus_package_is_optional_by_specification():
    assert importlib.util.find_spec("tidemark") is not None


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_every_query_runs(spark):
    """Each registered query of the payment part, whole, on the smallest tables."""
    from tidemark.plans import queries as plans

    for name, query in plans.queries().items():
        df = query(spark, str(DATA))
        assert df.columns and len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()
