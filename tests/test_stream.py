"""Streams give what the batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from candlewick.operators import signals
from candlewick.streaming import bars

SCHEMA = "event_id long, symbol string, t string, price double, volume double"


def ticks(spark, rows):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = [(i, s, (datetime(2024, 1, 1) + timedelta(seconds=x)).isoformat(sep=" "), float(p), 1.0) for i, s, x, p in rows]
    return spark.createDataFrame(table, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def run(frame, path, keys, mode="append"):
    q = frame.writeStream.foreachBatch(bars.insert_if_absent(f"{path}/rows", keys)).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.parquet(f"{path}/rows")


def test_windows_close_once_and_late_rows_go(spark, tmp_path):
    rows = [(i, "s", i * 20, i % 9) for i in range(300)]
    ticks(spark, rows[:200]).coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks(spark, rows[190:]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ticks(spark, [(999, "s", 5, 100), (1000, "s", 6001, 3)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frame = bars.windowed(bars.deduplicated(stream(spark, f"{tmp_path}/in"), ["event_id"]), "5m", watermarked=True)
    found = {r.ts.hour * 60 + r.ts.minute: tuple(r)[2:] for r in run(frame, str(tmp_path), ["symbol", "ts"]).collect()}
    for k in range(18):
        inside = [(x, p) for _, _, x, p in rows if k * 300 <= x < (k + 1) * 300]
        prices = [float(p) for _, p in sorted(inside)]
        assert found[k * 5] == (prices[0], max(prices), min(prices), prices[-1], float(len(prices)), len(prices))
    again = run(frame, str(tmp_path), ["symbol", "ts"])
    assert again.count() == len(found)


def test_insert_if_absent(spark, tmp_path):
    write = bars.insert_if_absent(f"{tmp_path}/t", ["k"])
    write(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_latest_price_ignores_older_ticks(spark):
    table = ticks(spark, [(1, "s", 10, 5), (2, "s", 30, 7), (3, "s", 20, 9), (4, "s", 30, 8)]).withColumn("ts", F.col("t").cast("timestamp"))
    assert bars.latest_price(table).first().price == 8.0


def test_upsert_and_fresh(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "k int, v string, enabled int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, enabled int")
    assert sorted(map(tuple, signals.upserted(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 1)]
    assert sorted(map(tuple, signals.upserted(old, new, ["k"], keep=("enabled",)).collect())) == [(1, "a", 1), (2, "c", 0), (3, "d", 1)]
    incoming = spark.createDataFrame([(3, "x", 2), (3, "y", 1), (2, "z", 1)], "k int, v string, seq int")
    assert [tuple(r) for r in signals.fresh(incoming, old, ["k"], "seq").collect()] == [(3, "y", 1)]


def test_system_definitions_are_inserted_once(spark):
    schema = "id long, user_id long, code string, version string"
    stored = spark.createDataFrame([(1, 0, "SMA", "v1"), (2, 7, "EMA", "v1")], schema)
    incoming = spark.createDataFrame([(11, 3, "SMA", "v1"), (12, 3, "EMA", "v1"), (13, 0, "EMA", "v1"), (14, None, "SMA", "v2")], schema)
    found = signals.system_definitions(incoming, stored, "id").collect()
    assert sorted((r.id, r.user_id, r.code, r.version) for r in found) == [(12, 0, "EMA", "v1"), (14, 0, "SMA", "v2")]
