"""The registry against DuckDB, and the entry module without the corpus folders."""

import os
import subprocess
import sys

import duckdb
import pytest

from chronoloom.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_works_without_the_corpus_folders(tmp_path):
    for name in ("__spark_entry__.py", "chronoloom"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "chronoloom").mkdir()
    for name in os.listdir(f"{ROOT}/chronoloom"):
        if name != "llm" and not name.startswith("__pycache__"):
            os.symlink(f"{ROOT}/chronoloom/{name}", tmp_path / "chronoloom" / name)
    code = "import __spark_entry__ as e; assert 'assemble_lines' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_active_video_has_a_plan(spark, tmp_path):
    """Two jobs; the second place of the first has two versions of different lengths."""
    import datetime

    day = lambda k: datetime.date(2024, 1, k)
    items = [(1, 1, 1.0, day(1)), (1, 2, 2.0, day(1)), (1, 2, 45.0, day(2)), (1, 3, 0.05, day(1)), (2, 2, 3.0, day(3)), (2, 3, 0.0, day(3))]
    df = spark.createDataFrame([(j, n, q, d, 1, 1, 1.0) for j, n, q, d in items], "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate date, l_partkey long, l_suppkey long, l_extendedprice double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    want, names = [], []
    for job, place, quantity in [(1, 0, 1.0), (1, 1, 45.0), (1, 2, 0.05), (2, 1, 3.0)]:
        k, length = 0, quantity * 60
        while k == 0 or k * 2 < length:
            t = k * 2
            want.append((job, place, k, float(t), f"{k + 1:06d}_t{t // 3600:02d}{t // 60 % 60:02d}{t % 60:02d}.jpg", k // 20, f"batch_{k // 20 + 1:04d}"))
            names.append((job, place, k + 1, t))
            k += 1
    found = registry.queries()
    assert sorted(tuple(r) for r in found["f30_every_picture"](spark, str(tmp_path)).collect()) == want
    assert sorted(tuple(r) for r in found["s10_every_picture_name"](spark, str(tmp_path)).collect()) == names


def test_a_name_is_read_once_for_all_videos(spark):
    """Names of the shared places are read below the join with the videos' batches, not in each of their rows."""
    tree = registry.queries()["s10_every_picture_name"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in tree and tree.index("Join Inner") < tree.index("substring_index")
