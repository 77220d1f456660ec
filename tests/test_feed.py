from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tempora.catalog import feed, streams


def test_feed_takes_its_range_from_the_events(spark, tmp_path):
    start = datetime(2023, 11, 5, 7)
    hours = [start + timedelta(hours=i) for i in range(60)]
    events = spark.createDataFrame([(str(h + timedelta(minutes=5)),) for h in hours], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert streams.hours_between(spark, str(tmp_path)) == (hours[0], hours[-1])
    df = spark.createDataFrame([("A", str(h)) for h in hours], "station_id string, t string").select("station_id", F.col("t").cast("timestamp").alias("timestamp_utc"))
    assert streams.feed(spark, str(tmp_path), df, "f", lambda h: h).count() == 60


def test_rows_outside_the_named_range_are_delivered(spark, hour):
    df = spark.createDataFrame([("A", i) for i in range(-5, 20)], "station_id string, i int")
    df = df.select("station_id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,i)").alias("timestamp_utc"))
    assert feed.run_feed(df, "o", 3, hour(0), hour(9), lambda h: h).count() == 25
