"""A stream that gets the table in several files gives what it gives of one."""

from pyspark.sql import functions as F

from windrow.plans import streams

SF = "/root/testdata/sf0.001"


def test_files_in_time_order_give_the_same_windows(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events.parquet")
    for query, order in ((streams.streamed_windows, ["start", "event_type"]), (streams.streamed_sessions, ["user_id", "started"])):
        one, many = (query(spark, d).orderBy(*order).collect() for d in (SF, str(tmp_path)))
        assert one and one == many
    assert streams.streamed_windows(spark, SF).agg(F.sum("n")).first()[0] <= 2 * e.count()
