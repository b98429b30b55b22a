"""The streams give what the batch operators give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators.admission import coupled_windows, sliding_log, window_counts
from quern.streaming.admission import coupled_windows_stream, first_seen_stream, sliding_log_stream, window_counts_stream
from quern.streaming.collect import merge_batches, read_index


def landed(spark, tmp_path, df, parts):
    folder = str(tmp_path / "in")
    for n in range(parts):
        df.where(f"part = {n}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, tmp_path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_admission_streams(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(i % 4, i, int((start + timedelta(minutes=7 * i)).timestamp()), start + timedelta(minutes=7 * i), i // 100) for i in range(300)]
    df = spark.createDataFrame(rows, "client long, event_id long, epoch long, ts timestamp, part int")
    stream = landed(spark, tmp_path, df, 3)
    got = run(sliding_log_stream(stream, 3, 7200), tmp_path, "log")
    assert sorted(map(tuple, got.select("event_id", "allowed").collect())) == sorted(map(tuple, sliding_log(df, 3, 7200).collect()))
    both = run(coupled_windows_stream(stream, 1, 20), tmp_path, "both")
    assert sorted(map(str, both.select("event_id", "allowed", "scope").collect())) == sorted(map(str, coupled_windows(df, 1, 20).select("event_id", "allowed", "scope").collect()))
    closed = {tuple(r) for r in run(window_counts_stream(stream, 3600, "1 minute"), tmp_path, "counts").collect()}
    every = {tuple(r) for r in window_counts(df, 3600).collect()}
    assert closed and closed <= every and len(every - closed) <= 8
    assert run(first_seen_stream(stream, "client", "30 days"), tmp_path, "seen").count() == 4


def test_merge_is_idempotent(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [("k1", "r1", "a", start, 0), ("k2", "r1", "b", start, 0), ("k1", "r2", "c", start + timedelta(1), 1), ("k1", "r0", "d", start, 1)]
    df = spark.createDataFrame(rows, "key string, revision string, alias string, ts timestamp, part int")
    stream, root = landed(spark, tmp_path, df, 2), str(tmp_path / "index")
    want = [("k1", "r2", ["a", "c", "d"]), ("k2", "r1", ["b"])]
    for _ in range(2):
        merge_batches(stream, root, str(tmp_path / "cp")).awaitTermination()
        assert sorted(map(tuple, read_index(spark, root).collect())) == want
    merge_batches(stream, root, str(tmp_path / "cp-lost")).awaitTermination()
    assert sorted(map(tuple, read_index(spark, root).select("key", "revision", F.array_sort("aliases")).collect())) == want
