"""Text of pages, advisory dates, and the deviation of speeds."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from courierworks.functions import text
from courierworks.operators import fleet


def test_visible_text(spark):
    page = "<style>p{x}</style>a &amp; b<br/>c<SCRIPT a=1>if (x < 1) y</SCRIPT >d<p>e</P>1 < 2 <>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "<script>open")], "id long, html string")
    got = {(r.id, r.line) for r in text.html_lines(rows, "id").collect()}
    assert got == {(1, "a & b"), (1, "c d e"), (1, "1 < 2 <>"), (3, "open")}


def test_advisory_dates(spark):
    title = "<h1>Weekly Traffic Advisory for</h1> Weekly Traffic Advisory for Saturday March 2, 2024, to Friday MARCH 8, 2024</h1>"
    rows = spark.createDataFrame([(1, title), (2, "Weekly Traffic Advisory for Saturday Mach 2, 2024, to"), (3, "")], "id long, html string")
    now = datetime(2024, 1, 1)
    start, end = text.advisory_window(F.col("html"), F.lit(now))
    got = {r.id: (r.s, r.e) for r in rows.select("id", F.unix_micros(start).alias("s"), F.unix_micros(end).alias("e")).collect()}
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got[1] == (us(datetime(2024, 3, 2, 5)), us(datetime(2024, 3, 9, 4, 59)))
    assert got[2] == got[3] == (us(now - timedelta(hours=2)), us(now + timedelta(days=7)))


def test_deviation_near_a_constant_speed(spark):
    rows = spark.range(100_000).select(
        F.lit("c").alias("courier_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(40.7).alias("lat"), F.lit(-73.9).alias("lon"),
        (F.lit(1e8) + F.col("id") % 2).alias("speed_kmh"), F.lit("idle").alias("status"))
    assert fleet.driver_scores(rows).first().speed_stddev == 0.5
