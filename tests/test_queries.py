"""Every query with SQL gives the rows that DuckDB gives; the rest of the library stands without the optional folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    cell = lambda x: str(pd.Timestamp(x)) if hasattr(x, "isoformat") else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None if x is None else str(x)
    return sorted(tuple(str(cell(x)) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, str(DATA)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


def test_entry_stands_without_the_optional_folders(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "vigilframe").mkdir()
    for p in (root / "vigilframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "vigilframe" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.dont_write_bytecode = True\nimport importlib.util as u\ns = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\nprint(sorted(k for k in m.queries() if k.startswith('op') or k == 'pipeline'), len(m.queries()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.strip() == "[] True", out.stderr[-500:]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_customers_are_dealt(spark):
    """A small file of many rows is no single task."""
    from vigilframe.queries import _customer_hosts

    assert "RepartitionByExpression" in _customer_hosts(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
