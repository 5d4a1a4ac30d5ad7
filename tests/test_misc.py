import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandline.__main__ import main
from strandline.plans import data_queries, modes, series_queries
from strandline.runtime import key_codes, materialize, shared_dir, whole_groups
from strandline.sources.tables import constant_series, csv_series
from strandline.streaming.weighted import streaming_ewma, streaming_windows

ROOT = Path(__file__).resolve().parent.parent


def test_modes_and_shims(spark, tmp_path):
    modes.set_mode("fast")
    assert modes.get_mode() == "fast"
    with pytest.raises(ValueError):
        modes.set_mode("warp")
    modes.set_mode("safe")
    w = modes.Workspace(10)
    w.reserve(5), w.reserve(40)
    assert w.size == 40
    assert "spark" in modes.build_features(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    saved = modes.save_settings(spark, str(tmp_path / "s.json"))
    assert modes.calibrate(spark, 10 << 30)["spark.sql.shuffle.partitions"] == "80"
    assert modes.load_settings(spark, str(tmp_path / "s.json")) == saved and spark.conf.get("spark.sql.shuffle.partitions") == before
    (tmp_path / "bad.json").write_text(json.dumps({"spark.evil": "1"}))
    with pytest.raises(ValueError):
        modes.load_settings(spark, str(tmp_path / "bad.json"))


def test_command_line(spark, capsys):
    assert main(["version"]) == 0 and main(["list"]) == 0 and main(["test"]) == 0 and main(["what"]) == 1
    assert "sensor_screening" in capsys.readouterr().out


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,v\n2020-01-01,1.5\n2020-01-02,\n")
    rows = csv_series(spark, str(tmp_path / "x.csv"), "date date, v double").orderBy("date").collect()
    assert rows[0]["v"] == 1.5 and rows[1]["v"] is None and rows[0]["date"] == dt.date(2020, 1, 1)
    assert [r["x"] for r in constant_series(spark, 3, 2).collect()] == [2, 2, 2]


def test_whole_groups_and_written_tables(spark):
    import pyarrow as pa

    keys = [None, None, "a", "a", "a", "b", "c", "c"]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 3], pa.string()), "v": list(range(i, min(i + 3, 8)))}) for i in range(0, 8, 3)]
    tables = list(whole_groups(iter(batches), ["k"], rows=2))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(8))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == 4
    assert key_codes(tables[0].slice(0, 0), ["k"]).tolist() == []
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark)


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(0)
    folder, start = tmp_path / "in", dt.datetime(2024, 1, 1)
    x = rng.normal(5, 1, 30)
    for k in range(3):
        pdf = pd.DataFrame({"s": "a", "ts": [start + dt.timedelta(minutes=i) for i in range(10 * k, 10 * k + 10)], "v": x[10 * k : 10 * k + 10]})
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = streaming_ewma(stream, "v", "ts", "s", 0.3).writeStream.format("memory").queryName("ew").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(120)
    got = spark.table("ew").toPandas()
    assert len(got) == 30 and got.n.max() == 30 and np.isclose(got.total.max(), x.sum())
    arrived = got.sort_values("n").value
    assert np.allclose(got.sort_values("n").ewma, arrived.ewm(alpha=0.3, adjust=False).mean())
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = streaming_windows(stream, "v", "ts", "s", "10 minutes", "5 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    assert q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("win").collect()) == [10, 10, 10]


def test_registry(spark, data):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and {f"p{n}_found" for n in (1, 2, 3, 4, 6)} <= names
    assert set(data_queries.QUERIES) | set(series_queries.QUERIES) <= names
    assert len(series_queries.SQL) == len(series_queries.QUERIES)
    assert __spark_entry__.entry(spark).columns == ["event_type", "n", "n_scored", "n_flagged"]


def test_rest_works_without_the_text_package():
    code = "import sys; sys.modules['strandline.llm'] = None\nimport __spark_entry__ as e; n = set(e.queries()); assert 'p1_found' in n and not any(x.startswith(('p7', 'p8', 'p9')) for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for p in (ROOT / "strandline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "strandline.llm" not in p.read_text()


@pytest.mark.parametrize("name, columns", [("p1_found", ["location", "day"]), ("p2_found", ["reading_id", "field"]), ("p3_found", ["series", "slot"]), ("p4_found", ["holiday_id"]), ("p6_found", ["table_name", "reading_id"])])
def test_found_queries(spark, data, name, columns):
    df = __spark_entry__.queries()[name](spark, data)
    assert df.columns == columns and df.count() == df.distinct().count() > 0
    assert df.where(F.col(columns[0]).isNull()).count() == 0
