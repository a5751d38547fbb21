"""Streams give what batches give."""

import datetime as dt
import time

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators import bars, pricing
from tidepool.streaming.stateful import stream_bars, stream_last_known
from tidepool.streaming.windows import hourly_mean

T0 = dt.datetime(2024, 1, 1)


def run(spark, df, schema, transform, tmp_path, files=4, mode="append"):
    """Streams df in time order, a few files at a time."""
    src, name = tmp_path / "in", f"out_{abs(hash(str(tmp_path)))}"
    # files one after the other: a stream takes them in order of their time
    for i in range(files):
        part = df.withColumn("_n", F.ntile(files).over(Window.orderBy("ts"))).where(F.col("_n") == i + 1).drop("_n")
        part.coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_bars(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [(f"p{i % 3}", T0 + dt.timedelta(seconds=i), i, (i * 7919) % 900, 2500) for i in range(600)]
    schema = "pool string, ts timestamp, tie long, micro long, limit long"
    df = spark.createDataFrame(rows, schema)
    want = {r.tie: (r.bar_no, r.closes) for r in bars.assign_bars(df).collect()}
    out = run(spark, df, schema, lambda s: stream_bars(s, "1 day"), tmp_path)
    assert {r.tie: (r.bar_no, r.closes) for r in out.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_last_known(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [("c", T0 + dt.timedelta(seconds=i * 31), i, f"t{i % 4}", float(i), i % 3 == 0) for i in range(400)]
    schema = "component string, ts timestamp, tie long, token string, price double, is_lookup boolean"
    df = spark.createDataFrame(rows, schema)
    e = df.where("not is_lookup").select(F.col("token"), "ts", "price")
    q = df.where("is_lookup").select("token", "ts", F.col("tie").alias("lookup_id"))
    want = {r.lookup_id: r.price for r in pricing.last_known(e, q, "token", "ts", "price", 90.0).collect()}
    out = run(spark, df, schema, lambda s: stream_last_known(s, 90.0, "1 day"), tmp_path)
    assert {r.tie: (None if r.price is None or r.price != r.price else r.price) for r in out.collect()} == want
    assert None in want.values()
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hourly_mean(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [(T0 + dt.timedelta(minutes=i * 7), f"t{i % 2}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, token_address string, price_in_usdc double")
    renamed = lambda x: hourly_mean(x.withColumnRenamed("ts", "block_timestamp"))
    out = run(spark, df, df.schema, renamed, tmp_path)
    want = {(r.token_address, r.hour_at): round(r.price, 9) for r in renamed(df).collect()}
    got = {(r.token_address, r.hour_at): round(r.price, 9) for r in out.collect()}
    # hours that can still change are not emitted yet
    assert got.items() <= want.items() and len(got) >= len(want) - 8
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rows_behind_the_watermark_count_nowhere(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "pool string, ts timestamp, tie long, micro long, limit long"
    src = tmp_path / "in"
    for k, hours in enumerate(([20], [21], [9, 22])):
        spark.createDataFrame([("p", T0 + dt.timedelta(hours=h), h, 600, 1000) for h in hours], schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_bars(stream, "1 hour").writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    assert {r.tie: (r.bar_no, r.closes) for r in spark.table("late_rows").collect()} == {20: (0, False), 21: (0, True), 22: (1, False)}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
