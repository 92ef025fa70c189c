import json

import pytest
from pyspark.sql import functions as F

from orrery import sources, streaming


def test_status_log(spark, tmp_path):
    for k, (t, s) in enumerate((("2020", "failed"), ("2021", "success"))):
        (tmp_path / f"{k}.json").write_text(json.dumps({"created_utc": t, "task_index": k, "events": [{"simulation_id": 7, "status": s}]}))
    (tmp_path / "bad.json").write_text("{oops")
    assert [(r.simulation_id, r.status) for r in sources.read_status(spark, str(tmp_path)).collect()] == [(7, "success")]


def test_publish(spark, tmp_path):
    df, path = spark.range(50).withColumn("x", F.col("id") % 7), str(tmp_path / "t")
    manifest = sources.publish(df, path, profile="test")
    assert manifest["rows"] == 50 and sources.verified(spark, path).count() == 50
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sources.publish(df, path)
    df.limit(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="differs"):
        sources.verified(spark, path)


def test_pointers_and_priority(spark):
    heads = spark.createDataFrame([("a", 1, 2), ("a", 3, 3)], "file string, ptr_min int, ptr_max int")
    rows = spark.createDataFrame([("a", k, k * 1.0) for k in range(1, 5)], "file string, pos int, flux double")
    assert sources.attach_pointers(heads, rows).count() == 3
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v) for r in sources.with_priority([one, two], ["k"]).collect()) == [(1, "a"), (2, "b")]


def stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_sessions_and_kth_detection(spark, tmp_path):
    rows = [(1, "r", "2020-01-01 00:00:00", 10.0, 1.0), (1, "r", "2020-01-01 02:00:00", 20.0, 1.0), (1, "r", "2020-01-01 05:00:00", 30.0, 1.0), (9, "r", "2020-03-01 00:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "object long, band string, ts string, flux double, error double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream(spark, str(tmp_path / "in"), df.schema)
    q = streaming.merged_sessions(s).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.object, r.flux, r.merged) for r in spark.table("sessions").collect())
    assert got == [(1, 15.0, 2), (1, 30.0, 1)]
    q = streaming.kth_detection(s, 2).writeStream.format("memory").queryName("kth").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.object, str(r.ts)) for r in spark.table("kth").collect()] == [(1, "2020-01-01 02:00:00")]


def test_latest_status_stream(spark, tmp_path):
    schema = "id long, at long, status string"
    q = None
    for k, rows in enumerate(([(1, 1, "failed"), (2, 1, "ok")], [(1, 2, "ok")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.latest_status(stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), key="id", by="at").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()) == [(1, 2, "ok"), (2, 1, "ok")]
