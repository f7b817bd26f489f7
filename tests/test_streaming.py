"""Readings as streams."""

import datetime as dt

import pytest
from meterflow.streaming import readings

READ = "meter_id string, ts timestamp, import_kwh double, export_kwh double, modified timestamp"


def test_quarter_hours_close_behind_the_watermark(spark, tmp_path):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("m", t(0, 1), "import", 1.0), ("m", t(0, 14), "import", 2.0), ("m", t(0, 5), "export", 4.0), ("m", t(5, 0), "import", 8.0)]
    spark.createDataFrame(rows, "meter_id string, ts timestamp, channel string, kwh double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("meter_id string, ts timestamp, channel string, kwh double").parquet(str(tmp_path / "in"))
    q = readings.quarter_hours(stream).writeStream.format("memory").queryName("quarters").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT window.start AS s, import_kwh, export_kwh FROM quarters").collect()
    assert [(r.s, r.import_kwh, r.export_kwh) for r in got] == [(t(0, 0), 3.0, 4.0)]


def test_revisions_win_and_repeats_change_nothing(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    path, source = str(tmp_path / "table"), tmp_path / "in"
    first = [("m", dt.datetime(2024, 1, 1, 6), 1.0, 0.0, day(2)), ("m", dt.datetime(2024, 2, 1, 6), 5.0, 0.0, day(2))]
    spark.createDataFrame(first, READ).write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema(READ).option("recursiveFileLookup", "true").parquet(str(source))
    readings.sink(stream(), path, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 6), 9.0, 0.0, day(3)), ("m", dt.datetime(2024, 1, 1, 7), 2.0, 0.0, day(3))], READ).write.parquet(str(source / "b"))
    readings.sink(stream(), path, str(tmp_path / "cp")).awaitTermination()
    late = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 6), 4.0, 0.0, day(1))], READ)
    for _ in range(2):
        readings.upserted(late, path, spark)
    got = {(r.month, r.ts.hour): r.import_kwh for r in spark.read.parquet(path).collect()}
    assert got == {("2024-01", 6): 9.0, ("2024-01", 7): 2.0, ("2024-02", 6): 5.0}


def test_prices_join_late(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 6)
    spark.createDataFrame([("m", at, 1.0)], "meter_id string, ts timestamp, import_kwh double").write.parquet(str(tmp_path / "u"))
    spark.createDataFrame([(at, 0.05)], "price_ts timestamp, price_usd_kwh double").write.parquet(str(tmp_path / "p"))
    u = spark.readStream.schema("meter_id string, ts timestamp, import_kwh double").parquet(str(tmp_path / "u"))
    p = spark.readStream.schema("price_ts timestamp, price_usd_kwh double").parquet(str(tmp_path / "p"))
    q = readings.priced(u, p).writeStream.format("memory").queryName("priced").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.import_kwh, r.price_usd_kwh) for r in spark.sql("SELECT * FROM priced").collect()] == [(1.0, 0.05)]


def test_an_unreadable_table_is_never_overwritten(spark, tmp_path):
    batch = spark.sql("SELECT 'm' AS meter_id, TIMESTAMP'2024-01-08 06:00:00' AS ts, 1.0D AS import_kwh, 0.0D AS export_kwh, 1 AS modified")
    at = tmp_path / "table" / "month=2024-01"
    at.mkdir(parents=True)
    (at / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark says of the file
        readings.upserted(batch, str(tmp_path / "table"), spark)
    assert (at / "part-0.parquet").read_bytes() == b"not parquet"


def test_months_so_far_by_local_time(spark):
    rows = spark.sql("SELECT 'm' AS meter_id, explode(array(TIMESTAMP'2024-02-01 05:45:00', TIMESTAMP'2024-02-01 06:00:00', TIMESTAMP'2024-02-01 06:15:00')) AS ts, 1.5D AS import_kwh, 0.5D AS export_kwh")
    got = sorted(tuple(r) for r in readings.month_state(rows).collect())
    assert got == [("m", "2024-01", 1.5, 0.5, 1), ("m", "2024-02", 3.0, 1.0, 2)]
