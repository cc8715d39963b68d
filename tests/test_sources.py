import datetime as dt

import pytest

from ebbflow.operators import areas as ar
from ebbflow.operators.clean import sanitize_ts
from ebbflow.session import settle, shared_dir
from ebbflow.sources import io


def test_gauge_files(spark, tmp_path):
    (tmp_path / "12a. Ray, Grendon, UK, 2019.csv").write_text("2001-01-01,1.5\n2001-01-02,-0.999\n2001-01-04,2\n")
    (tmp_path / "7. Elbe, Neu Darchau, Germany, 2019.csv").write_text("01-02-1999,3\nbad,4\n02-02-1999,5\n")
    (tmp_path / "notes.csv").write_text("2001-01-01,9\n")
    raw = io.read_gauge_files(spark, str(tmp_path))
    got = {(r["series_id"], r["river"], r["site"], r["country"]) for r in raw.collect()}
    assert got == {("12a", "Ray", "Grendon", "UK"), ("7", "Elbe", "Neu Darchau", "Germany")}
    clean = sanitize_ts(raw, "ordinal").series.where("series_id = '12a'").orderBy("time").collect()
    assert [r["value"] for r in clean] == [1.5, None, None, 2.0]
    assert raw.where("series_id = '7' and time is null").count() == 1


def test_descriptors_do_not_shift(spark, tmp_path):
    path = tmp_path / "descriptors.txt"
    path.write_text("id\tarea\tq\n1\t100\t5.5\t0.1\n2\t200\t6.5\t0.2\n")
    rows = io.read_descriptors(spark, str(path)).orderBy("_row").collect()
    assert [(r["_row"], r["id"], r["area"], r["q"]) for r in rows] == [(1, 100.0, 5.5, 0.1), (2, 200.0, 6.5, 0.2)]


def test_tsv(spark, tmp_path):
    path = tmp_path / "pair.txt"
    path.write_text("day\tQsim\tQobs\n2001-01-01\t1\t2\n")
    df = io.read_tsv(spark, str(path), "day date, Qsim double, Qobs double", time="day", benchmark="Qsim",
                     influenced="Qobs")
    assert [tuple(r) for r in df.collect()] == [(dt.date(2001, 1, 1), 1.0, 2.0)]


def test_export_passes_the_table_on(spark, tmp_path):
    df = spark.range(3)
    assert io.export_table(df, "Tab1", str(tmp_path)) is df
    assert spark.read.parquet(str(tmp_path / "Tab1")).count() == 3


def test_bucketed_observations_need_no_shuffle(spark, series, tmp_path):
    from ebbflow.operators.indices import annual_minima

    spark.sql(f"CREATE DATABASE IF NOT EXISTS obs LOCATION '{tmp_path}/db'")
    io.write_observations(series({"a": range(400), "b": range(400)}), "obs.daily", buckets=4)
    stored = io.dataset(spark, "obs.daily")
    plan = annual_minima(stored, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(series_id" not in plan
    assert annual_minima(stored, 7).count() == 4
    spark.sql("DROP DATABASE obs CASCADE")


def test_settle_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)
    assert shared_dir(spark) == folder
    df = settle(spark.range(5))
    assert df.count() == 5
    assert all(folder.removeprefix("file:") in f.removeprefix("file://") for f in df.inputFiles())


@pytest.mark.parametrize("name", ["ship_daily", "supplier_daily", "nation_daily"])
def test_series_hold_one_row_per_day(spark, name):
    import os

    from ebbflow.sources import series as src

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables not available")
    df = getattr(src, name)(spark, folder)
    assert df.count() == df.select("series_id", "time").distinct().count()


FOREIGN = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_point", sys.argv[1])
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
for name in sys.argv[3:]:
    print(name, len(module.queries()[name](spark, sys.argv[2]).collect()) > 0)
"""


def test_python_helpers_travel_with_the_query(tmp_path):
    """Workers that cannot import the package still run its Arrow functions."""
    import os
    import subprocess
    import sys

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables not available")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = ["theil_sen", "structural_breaks", "break_intervals", "linear_trend", "pca_loadings", "area_kriging",
             "smoothed_quantile_curves", "regional_regression", "robust_regression", "sample_variogram"]
    script = tmp_path / "foreign.py"
    script.write_text(FOREIGN)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), f"{root}/__spark_entry__.py", folder, *names],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert sum(line.split()[0] in names for line in done.stdout.splitlines() if line.strip()) == len(names)


def test_areas_and_points(spark, tmp_path):
    areas, points = str(tmp_path / "areas"), str(tmp_path / "points")
    spark.createDataFrame([(1.0, 200.0, 3.5, 0.7, 9.0)], "EZGID double, HZBNR double, AREASQKM double, Q95 double, extra double").write.parquet(areas)
    spark.createDataFrame([(1.0, 0.1, 0.2), (1.0, 0.3, 0.2), (1.0, None, 0.2)], "EZGID double, x double, y double").write.parquet(points)
    row = io.read_areas(spark, areas).first()
    assert row.asDict() == {"area_id": "1", "gauge": "200", "area_km2": 3.5, "q95": 0.7, "specific_q95": None}
    cells = ar.discretise(io.read_points(spark, points), 0.15).collect()
    assert sorted((c["area_id"], c["weight"]) for c in cells) == [("1", 0.5), ("1", 0.5)]
