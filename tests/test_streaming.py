from panelkiln.sources.panels import events_daily
from panelkiln.streaming.bars import stream_bars

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_bars_of_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{SF}/events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("bars").collect()))
    assert got == sorted(map(tuple, events_daily(spark, SF).collect()))
