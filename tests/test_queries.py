"""Every query with SQL against that SQL on the smallest tables; queries run without the document operators."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from hypso.operators import bands
from hypso.plans import areas, connect, elements, terrain
from hypso.sources import rasters

QUERIES = {**terrain.QUERIES, **areas.QUERIES, **connect.QUERIES, **elements.QUERIES}
ORACLE = {**terrain.ORACLE, **areas.ORACLE, **connect.ORACLE, **elements.ORACLE}
TABLES = ("lineitem", "nation", "customer", "supplier", "orders", "events", "pages")


@pytest.fixture(scope="module")
def engine(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    one = lambda x: "-" if x is None or pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, engine, tiny, name):
    found, told = QUERIES[name](spark, tiny).toPandas(), engine.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    assert plain(found) == plain(told) and len(found)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE])
def test_query_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_simplifying_never_adds(spark, tiny):
    whole = {(r["cell"], r["level"]): r["n_segments"] for r in QUERIES["contour_counts"](spark, tiny).collect()}
    for r in QUERIES["rdp_simplify"](spark, tiny).collect():
        assert r["nodes"] <= 2 * whole[r["cell"], r["level"]]


def test_entry_stands_alone(tmp_path):
    """Without the document operators the entry module imports and has the other queries."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in ("__spark_entry__.py", "hypso"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "hypso" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dem_scan' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_plans_push_down(spark, tiny):
    """The grid reads three of lineitem's columns and shuffles partial sums."""
    plan = QUERIES["dem_scan"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan and "partial_sum" in plan
    assert "Python" not in plan


def test_segments_of_files_need_no_shuffle(spark, tmp_path):
    """From files to row costs and to segments nothing is exchanged, and a file is decoded by one scan."""
    (tmp_path / "N00E000.hgt").write_bytes(b"\0\1" * 81)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    own = rasters.bands(files).select(F.col("path").alias("cell"), F.lit(0).cast("long").alias("file_seq"), "own", "top", "n_cols", "z")
    for found in (bands.costs(own), bands.segments(own, 20)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan") == 1
