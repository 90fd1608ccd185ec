import shutil

from pyspark.sql import functions as F

from pitwell.streaming.bars import event_counts


def test_event_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    q = event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == batch.count()
