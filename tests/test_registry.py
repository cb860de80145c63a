"""Every query with an oracle against DuckDB, and the plans of some."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from eventlake import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "\0" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf, oracle, name):
    df = registry.queries()[name](spark, sf)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_are_broadcast(spark, sf):
    df = registry.queries()["stats_zscore"](spark, sf)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    assert "BroadcastNestedLoopJoin" in text
    # the one window numbers offsets by partition; none spans all rows
    assert "Window [avg" not in text and "windowspecdefinition(ROWS" not in text


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(registry.queries()["vector_dot_and_norm"](spark, sf))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    assert "Python" not in "".join(plan(registry.queries()[n](spark, sf)) for n in ("tumble_purchases_1h", "group_by_payload", "join_full", "stats_anomaly", "compact_latest"))


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_training_data_operators(tmp_path, also):
    """The entry imports, and has the other queries, where the subpackage and its tests are gone, whether or not the pipeline is."""
    repo = tmp_path / "repo"
    shutil.copytree(Path(__file__).parents[1], repo, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == 'op' or n == 'pipeline' for n in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql())), "0"]
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=repo, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout
