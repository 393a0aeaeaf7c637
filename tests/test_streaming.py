from pyspark.sql import functions as F

from assayer.streaming import events as S
from tests.conftest import DATA


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_windows_and_sessions(spark, tmp_path):
    e, stream = source(spark, tmp_path)
    got = drained(spark, S.sliding(stream, "ts", ["event_type"], "value", "1 day", "12 hours", "40 days"), "sliding", "complete")
    want = e.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r.event_type, r.start, r.n) for r in got.collect()) == sorted((r.event_type, r.w.start, r.n) for r in want.collect())
    got = drained(spark, S.sessions(stream, "ts", ["user_id"], "6 hours", "40 days"), "sessions", "complete")
    want = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    assert sorted((r.user_id, r.start, r.n) for r in got.collect()) == sorted((r.user_id, r.w.start, r.n) for r in want.collect())


def test_confusion_adds_up(spark, tmp_path):
    e, stream = source(spark, tmp_path)
    truth, predicted = F.col("event_type") == "view", F.col("value") > 50
    got = drained(spark, S.running_confusion(stream, "ts", truth, predicted, "1 day", "40 days"), "confusion", "complete").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn"))).first()
    assert got.tp + got.fp + got.tn + got.fn == e.count() and got.tp == e.where(truth & predicted).count()


def test_first_of_copies(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "A  b"), ("2024-01-01 00:00:01", "a b "), ("2024-01-01 00:00:02", "c")], "t string, x string").select(F.to_timestamp("t").alias("t"), "x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x string").parquet(str(tmp_path / "in"))
    assert drained(spark, S.first_of_copies(stream, "t", "x", "1 hour"), "copies").count() == 2
